"""Fixed values of the evidence rules: orders, weights, scores, policies, word lists. Data only."""

# Weights of a label by where it is found, caps and orders of the ranking.
SIGNAL_WEIGHTS = {"title": 30, "mesh_major": 30, "mesh": 20, "author_keyword": 18, "abstract": 10}
SIGNAL_CAP = 50
SAMPLE_CAP = 10_000
CLASS_ORDER = {"direct": 0, "class_level": 1, "contextual": 2, "irrelevant": 3}
SECTION_ORDER = {"key_evidence": 0, "important_updates": 1, "exploratory_evidence": 2}
TIER_ORDER = {"higher_strength": 0, "moderate_strength": 1, "limited_strength": 2, "signal_only": 3, "preclinical": 4, "not_assessable": 5}
DESIGN_RANK = {
    "systematic_review_meta_analysis": 0,
    "randomized_controlled_trial": 1,
    "systematic_review_without_meta_analysis": 2,
    "prospective_cohort": 3,
    "retrospective_cohort": 4,
    "case_control": 5,
    "cross_sectional": 6,
    "case_series": 7,
    "case_report": 8,
    "pharmacovigilance_disproportionality": 9,
    "narrative_review": 10,
}

# Intents by trigger phrase, and words of animal work and of people.
INTENTS = {
    "safety": ("safety", "adverse", "side effect", "tolerability", "pharmacovigilance", "faers", "toxicity", "complication"),
    "efficacy": ("efficacy", "effectiveness", "outcome", "response", "benefit", "superior", "noninferior", "randomized", "treatment", "therapy"),
    "emerging_pharmacotherapy": ("emerging pharmacotherapy", "emerging treatment", "drug development", "new indication"),
    "mechanism_research_trends": ("mechanism", "pathway", "research trend", "translational", "novel target"),
}

# Evidence levels by publication type (first match wins), their scores, ordinals and bonuses.
EVIDENCE_LEVELS = (
    ("guideline", ("guideline",)),
    ("systematic_review", ("systematic review", "meta-analysis")),
    ("randomized_trial", ("randomized controlled trial", "controlled clinical trial", "pragmatic clinical trial", "clinical trial")),
    ("observational", ("observational study", "cohort studies", "case-control studies", "cross-sectional studies", "longitudinal studies", "retrospective", "prospective")),
    ("narrative_review", ("review", "comment", "editorial", "letter", "consensus", "expert opinion")),
)
EVIDENCE_SCORE = {"guideline": 95, "systematic_review": 90, "randomized_trial": 85, "observational": 65, "narrative_review": 45, "other": 30}
EVIDENCE_ORDINAL = {"guideline": 6, "systematic_review": 5, "randomized_trial": 4, "observational": 3, "narrative_review": 2, "other": 1}
EVIDENCE_BONUS = {"guideline": 100, "systematic_review": 90, "randomized_trial": 80, "observational": 60, "narrative_review": 40, "other": 20}

# Publication integrity.
INTEGRITY_PRECEDENCE = {"unknown": -1, "no_signal": 0, "corrected_or_updated": 1, "expression_of_concern": 2, "retracted": 3}
RELATION_POLICY = {
    "retraction_in": ("retracted", "primary_article"),
    "retraction_of": ("retracted", "retraction_notice"),
    "expression_of_concern_in": ("expression_of_concern", "primary_article"),
    "expression_of_concern_for": ("expression_of_concern", "expression_of_concern_notice"),
    "erratum_in": ("corrected_or_updated", "primary_article"),
    "erratum_for": ("corrected_or_updated", "correction_notice"),
    "corrected_and_republished_in": ("corrected_or_updated", "primary_article"),
    "corrected_and_republished_from": ("corrected_or_updated", "primary_article"),
    "update_in": ("corrected_or_updated", "primary_article"),
    "update_of": ("corrected_or_updated", "other_integrity_notice"),
    "republished_in": ("corrected_or_updated", "primary_article"),
    "republished_from": ("corrected_or_updated", "primary_article"),
    "retracted_and_republished_in": ("retracted", "primary_article"),
    "retracted_and_republished_from": ("corrected_or_updated", "primary_article"),
}
IGNORED_RELATIONS = ("associated_dataset", "associated_publication", "comment_in", "comment_on", "summary_for_patients_in", "original_report_in", "reprint_in", "reprint_of", "cites")
TYPE_POLICY = {
    "retracted publication": ("retracted", "primary_article"),
    "retraction of publication": ("retracted", "retraction_notice"),
    "expression of concern": ("expression_of_concern", "expression_of_concern_notice"),
    "published erratum": ("corrected_or_updated", "correction_notice"),
    "corrected and republished article": ("corrected_or_updated", "primary_article"),
}

# Term discovery.
LEAST_FREQUENCY, ACCEPT_SCORE, TITLE_BOOST, ABSTRACT_BOOST, BOOST_CAP = 2, 60, 5, 3, 5
RECENCY = ((90, 100), (180, 80), (365, 60))
RECENCY_LEAST = 40
NO_DATE_DAYS = 9999

# Terms that are never a topic's.
STOP_TERMS = (
    "humans", "human", "female", "male", "adult", "child", "children", "aged", "middle aged", "young adult", "adolescent", "infant", "infants", "animals", "animal", "mice", "rats", "rat", "mouse",
    "drug therapy", "therapeutic use", "treatment outcome", "drug effects", "metabolism", "physiology", "pathology", "etiology", "diagnosis", "therapy", "prevention and control", "epidemiology", "complications",
    "methods", "standards", "statistics and numerical data", "journal article", "review", "systematic review", "meta-analysis", "randomized controlled trial", "observational study", "clinical trial",
    "comparative study", "evaluation study", "validation study", "english abstract", "pubmed", "medline",
)

# Snapshot comparison.
ABSTENTIONS = ("not_reported", "not_extractable", "not_applicable", "unclear", "unknown", "unspecified")
NOT_SHOWN = ("unknown", "unclear", "not_reported", "not_extractable", "not_applicable")
CHANGE_PRIORITY = {"integrity": 1, "membership": 2, "relevance": 3, "study": 4, "extraction": 5, "review": 6, "ranking": 7, "placement": 7, "comparability": 8}

# Words of people and of animal work, and what joins the two in one phrase.
PEOPLE_JOINED = ("patients?", "participants?", "humans?")
PEOPLE_WORDS = ("humans?", "patients?", "participants?", "subjects?", "volunteers?", "cohort", "hospitalized", "pregnant", "pregnancy", "clinical trial")
ANIMAL_JOINED = ("mice", "mouse", "rats?", "animals?", "preclinical", r"in\s+vitro", r"cell\s+line")
ANIMAL_WORDS = (*ANIMAL_JOINED, "animal model", "murine", "zebrafish", r"ex\s+vivo")
JOINTS = ("and", "with", "alongside", r"as\s+well\s+as")


def one_of(words: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


MIXED = "|".join(rf"{one_of(a)}\s+(?:{'|'.join(JOINTS)})\s+{one_of(b)}" for a, b in ((PEOPLE_JOINED, ANIMAL_JOINED), (ANIMAL_JOINED, PEOPLE_JOINED)))

# Study designs by text, in order, with what they are called.
DESIGN_TEXT = (
    ("systematic_review_meta_analysis", r"\b(?:network )?meta[- ]analysis\b"),
    ("systematic_review_without_meta_analysis", r"\bsystematic review\b"),
    ("scoping_review", r"\bscoping review\b"),
    ("protocol", r"\b(?:study|trial) protocol\b|\bpropos(?:e|ed)\b[^.;]{0,80}\btrial\b"),
    ("case_series", r"\bcase series\b"),
    ("case_report", r"\bcase report\b"),
    ("pharmacovigilance_disproportionality", r"\b(?:pharmacovigilance|faers|disproportionality|reporting odds ratio|spontaneous reports)\b"),
    ("randomized_controlled_trial", r"\brandomi[sz]ed\b(?=[^.]{0,80}\btrial\b)|\btrial\b(?=[^.]{0,80}\brandomi[sz]ed\b)"),
    ("nonrandomized_interventional_study", r"\bnon[- ]?randomi[sz]ed\b"),
    ("diagnostic_accuracy", r"\bdiagnostic accuracy\b"),
    ("case_control", r"\bcase[- ]control\b"),
    ("cross_sectional", r"\bcross[- ]sectional\b"),
    ("retrospective_cohort", r"\bretrospective\b"),
    ("prospective_cohort", r"\bprospective\b[^.;]{0,50}\bobservational study\b|\bprospective cohort\b"),
    ("nonrandomized_interventional_study", r"\bobservational study\b"),
    ("pharmacokinetic_pharmacodynamic", r"\bpharmaco(?:kinetic|dynamic)s?\b"),
    ("mixed_human_preclinical", MIXED),
    ("in_vitro", r"\bin\s+vitro\b|\bcell line\b"),
    ("animal_preclinical", r"\b(?:animal model|animals?|mice|mouse|rats?|murine|zebrafish|preclinical|ex\s+vivo)\b"),
    ("narrative_review", r"\breview\b"),
    ("editorial_commentary_letter", r"\b(?:editorial|commentary|letter)\b"),
)
DESIGN_STRENGTH = {"publication_type": 3, "structured_abstract": 3, "title": 2, "abstract": 1, "keyword": 1}
DESIGN_ORDER = (
    "systematic_review_meta_analysis", "scoping_review", "guideline_or_consensus", "protocol", "case_series", "case_report",
    "pharmacovigilance_disproportionality", "randomized_controlled_trial", "nonrandomized_interventional_study", "diagnostic_accuracy",
    "case_control", "cross_sectional", "retrospective_cohort", "prospective_cohort", "pharmacokinetic_pharmacodynamic",
    "mixed_human_preclinical", "in_vitro", "animal_preclinical", "systematic_review_without_meta_analysis", "narrative_review",
    "editorial_commentary_letter",
)
COMPATIBLE_DESIGNS = (
    ("systematic_review_meta_analysis", "systematic_review_without_meta_analysis"),
    ("prospective_cohort", "nonrandomized_interventional_study"),
    ("protocol", "randomized_controlled_trial"),
)
