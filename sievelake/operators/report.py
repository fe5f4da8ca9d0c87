"""Reports as ordered lines: sections of placed evidence, changes between snapshots, concepts, warnings (K2-K4, K7, section 2.17).

A report is a table of (place, line): every heading and every card is a row with its place, made without collecting, so the
same plan writes one topic's report or those of all topics; ``write_report`` joins the lines of one topic, which are few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import display_value, html_escape, lookup
from sievelake.operators.publish import _fs

#: Sections of a report in order, with their headings (fixed values).
SECTIONS = {
    "key_evidence": "Key evidence",
    "important_updates": "Important updates",
    "early_safety_signals": "Early safety signals",
    "pharmacovigilance_signals": "Pharmacovigilance signals",
    "clinical_background_and_overview": "Clinical background and overview",
    "emerging_mechanisms_and_research_trends": "Emerging mechanisms and research trends",
    "additional_selected_evidence": "Additional selected evidence",
    "exploratory_evidence": "Exploratory evidence",
    "audit_only": "Audit only",
}


def markdown_text(text: Column) -> Column:
    """Text that can't act as markup: HTML escaped, signs of Markdown behind a backslash, on one line."""
    plain = F.regexp_replace(html_escape(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " ")
    return F.regexp_replace(plain, r"([\\`*_\[\]|])", r"\\$1")


def section_lines(placed: DataFrame, group: Sequence[str], title: str, fields: Mapping[str, str], style: str = "markdown") -> DataFrame:
    """K2, K3: a heading with its count for each section that has rows, then a card for each row by rank; fields are (label, column)."""
    markup = {"markdown": ("## {}", "- **{}** {}", markdown_text), "html": ("<h2>{}</h2>", "<article><h3>{}</h3><p>{}</p></article>", html_escape)}
    head, card, safe = markup[style]
    fill = lambda form, *parts: F.concat(*[x for lit, part in zip(form.split("{}"), [*parts, None], strict=True) for x in ((F.lit(lit),) if part is None else (F.lit(lit), part))])
    order = lookup({name: i for i, name in enumerate(SECTIONS)}, F.col("section"), len(SECTIONS))
    shown = F.concat_ws("; ", *[F.concat(F.lit(f"{label}: "), safe(display_value(F.col(c)))) for label, c in fields.items()])
    cards = placed.select(*group, order.alias("section_place"), F.lit(1).alias("kind"), F.col("rank").cast("long").alias("rank"), fill(card, safe(F.col(title)), shown).alias("line"))
    count = placed.groupBy(*group, "section").agg(F.count("*").alias("n"))
    name = F.concat(lookup(SECTIONS, F.col("section"), "Other"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    heads = count.select(*group, order.alias("section_place"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank"), fill(head, name).alias("line"))
    return heads.union(cards)


def change_lines(changes: DataFrame, key: str) -> DataFrame:
    """K7: a heading for each category that has changes, then its changes in the order of the comparison."""
    cells = [markdown_text(F.col(c)) for c in ("change_type", "field_path")] + [markdown_text(F.coalesce(F.col(c), F.lit("none"))) for c in ("baseline", "target")]
    line = F.concat(F.lit("- "), F.col(key).cast("string"), F.lit(": "), cells[0], F.lit(" "), cells[1], F.lit(", "), cells[2], F.lit(" to "), cells[3])
    rows = changes.select("priority", "category", F.lit(1).alias("kind"), F.col("change_id"), line.alias("line"))
    heads = changes.groupBy("priority", "category").agg(F.count("*").alias("n"))
    heads = heads.select("priority", "category", F.lit(0).alias("kind"), F.lit("").alias("change_id"), F.concat(F.lit("## "), F.col("category"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    return heads.union(rows)


def warning_lines(warnings: DataFrame, code: str) -> DataFrame:
    """The warnings section: each code once, with how many rows it concerns."""
    found = warnings.groupBy(code).agg(F.count("*").alias("n"))
    return found.select(F.col(code), F.concat(F.lit("- "), display_value(F.col(code)), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))


def write_report(lines: DataFrame, path: str, order: Sequence[str], title: str, style: str = "markdown") -> None:
    """One topic's lines as one file; an existing file is an error."""
    body = [r.line for r in lines.orderBy(*order).select("line").collect()]
    text = f"# {title}\n\n" + "\n".join(body) + "\n" if style == "markdown" else "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>" + "\n".join(body) + "</body></html>"
    fs, p = _fs(lines.sparkSession, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
