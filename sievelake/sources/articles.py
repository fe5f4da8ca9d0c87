"""Article sources: XML split and normal form (S6, S7, P1-P11), JSON lines, snapshots, landed lookups."""

from __future__ import annotations

import datetime
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = """pmid string, title string, abstract string, authors array<string>, journal string, publication_date date, publication_date_raw string,
electronic_publication_date date, is_epub_ahead_of_print boolean, publication_types array<string>, doi string, pubmed_url string, mesh_headings array<string>, keywords array<string>,
mesh_descriptors array<struct<text:string,ui:string,major_topic:boolean,supporting_pmid:string>>, abstract_sections array<struct<label:string,text:string>>,
integrity_relations array<struct<normalized_relation:string,raw_ref_type:string,related_pmid:string,related_doi:string,source_text:string>>"""

#: Names of months (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Relation types as the source writes them, and their normal names (fixed values).
REF_TYPES = {
    "RetractionIn": "retraction_in",
    "RetractionOf": "retraction_of",
    "ExpressionOfConcernIn": "expression_of_concern_in",
    "ExpressionOfConcernFor": "expression_of_concern_for",
    "ErratumIn": "erratum_in",
    "ErratumFor": "erratum_for",
    "CorrectedandRepublishedIn": "corrected_and_republished_in",
    "CorrectedandRepublishedFrom": "corrected_and_republished_from",
    "UpdateIn": "update_in",
    "UpdateOf": "update_of",
    "RepublishedIn": "republished_in",
    "RepublishedFrom": "republished_from",
    "RetractedandRepublishedIn": "retracted_and_republished_in",
    "RetractedandRepublishedFrom": "retracted_and_republished_from",
    "AssociatedDataset": "associated_dataset",
    "AssociatedPublication": "associated_publication",
    "CommentIn": "comment_in",
    "CommentOn": "comment_on",
    "SummaryForPatientsIn": "summary_for_patients_in",
    "OriginalReportIn": "original_report_in",
    "ReprintIn": "reprint_in",
    "ReprintOf": "reprint_of",
    "Cites": "cites",
}


def month(text: str | None) -> int | None:
    """P10: a month's number from its number, name or three letters."""
    text = (text or "").strip().lower()
    if text.isdigit():
        return int(text) if 1 <= int(text) <= 12 else None
    return next((i for i, name in enumerate(MONTHS, 1) if text and text in (name, name[:3])), None)


def _own(e: ET.Element | None) -> str:
    """The text before an element's first child, trimmed."""
    return (e.text or "").strip() if e is not None else ""


def _day(e: ET.Element | None, whole: bool) -> datetime.date | None:
    if e is None:
        return None
    y, m, d = (_own(e.find(k)) for k in ("Year", "Month", "Day"))
    number = month(m)
    if not y.isdigit() or number is None or (whole and not d):
        return None
    try:
        return datetime.date(int(y), number, int(d) if d else 1)
    except ValueError:
        return None


def article(e: ET.Element) -> dict:
    """One article element as a row."""
    pmid = _own(e.find(".//PMID"))
    sections = [{"label": s.get("Label") or "", "text": _own(s)} for s in e.iterfind(".//Abstract/AbstractText")]
    sections = [s for s in sections if s["text"]]
    authors = []
    for a in e.iterfind(".//AuthorList/Author"):
        group, last = _own(a.find("CollectiveName")), _own(a.find("LastName"))
        if name := group or (last and f"{last} {_own(a.find('Initials'))}".strip()):
            authors.append(name)
    mesh = [{"text": _own(m), "ui": m.get("UI") or "", "major_topic": m.get("MajorTopicYN") == "Y", "supporting_pmid": pmid} for m in e.iterfind(".//MeshHeading/DescriptorName")]
    printed = e.find(".//JournalIssue/PubDate")
    electronic = next((d for a in e.iterfind(".//ArticleDate[@DateType='Electronic']") if (d := _day(a, True))), None)
    published = _day(printed, False)
    relations = {}
    for c in e.iterfind(".//CommentsCorrectionsList/CommentsCorrections"):
        kind = c.get("RefType") or ""
        row = (REF_TYPES.get(kind, "unknown"), kind, _own(c.find("PMID")) or None, _own(c.find("DOI")) or None, _own(c.find("RefSource")))
        relations[row] = None
    names = ("normalized_relation", "raw_ref_type", "related_pmid", "related_doi", "source_text")
    return {
        "pmid": pmid,
        "title": _own(e.find(".//ArticleTitle")),
        "abstract": " ".join(s["text"] for s in sections),
        "authors": authors,
        "journal": _own(e.find(".//Journal/Title")),
        "publication_date": published,
        "publication_date_raw": " ".join(x for c in (printed if printed is not None else ()) if (x := _own(c))),
        "electronic_publication_date": electronic,
        "is_epub_ahead_of_print": electronic is not None and published is None,
        "publication_types": [x for t in e.iterfind(".//PublicationTypeList/PublicationType") if (x := _own(t))],
        "doi": next((_own(i) for i in e.iterfind(".//ArticleIdList/ArticleId[@IdType='doi']")), ""),
        "pubmed_url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else "",
        "mesh_headings": [m["text"] for m in mesh],
        "keywords": [x for k in e.iterfind(".//KeywordList/Keyword") if (x := _own(k))],
        "mesh_descriptors": mesh,
        "abstract_sections": [s for s in sections if s["label"]],
        "integrity_relations": [dict(zip(names, r, strict=True)) for r in sorted(relations, key=lambda r: [x or "" for x in r])],
    }


def parse_articles(xml: DataFrame, column: str = "value") -> DataFrame:
    """Article rows of XML documents (one document a row); a malformed document is an error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf[column].dropna():
                root = ET.fromstring(text)
                rows += [article(e) for e in ([root] if root.tag == "PubmedArticle" else root.iter("PubmedArticle"))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _columns()])

    return xml.select(column).mapInPandas(run, ARTICLE)


def _columns() -> list[str]:
    out, depth, part = [], 0, ""
    for c in ARTICLE + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return out


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """XML files, one whole file a row."""
    return parse_articles(spark.read.text(path, wholetext=True))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def first_source(*sources: DataFrame, key: str = "pmid") -> DataFrame:
    """The union of sources, of each key the row of the first source that has it."""
    from sievelake.operators.records import first_wins

    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("__source", F.lit(i))
        every = s if every is None else every.unionByName(s)
    return first_wins(every, [key], F.col("__source")).drop("__source")
