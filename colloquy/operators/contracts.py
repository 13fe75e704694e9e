"""Contracts of records: rule sets for operators.validate, as codes of what a row must hold.

Each takes the DataFrame and gives (code -> condition); a field that the table lacks counts as not filled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T

SHA = r"^sha256:[0-9a-f]{64}$"
#: Allowed values of the contracts.
SIGNAL_TYPES = ["guidance_revision", "analyst_pressure", "management_hedging", "uncertainty", "opportunity_commitment", "risk_friction", "neutral", "neutral/no_signal", "reassurance", "answer_shift"]
CANDIDATE_LABELS = ["guidance_revision", "guidance_statement", "analyst_pressure", "management_hedging", "uncertainty", "reassurance", "answer_shift", "neutral/no_signal"]
CHUNK_TYPES = [
    "prepared_remarks", "guidance_statement", "guidance_revision_candidate", "qa_question", "qa_answer", "qa_pair", "analyst_pressure_exchange", "management_hedging_span", "uncertainty_span",
    "reassurance_span", "answer_shift_candidate", "evidence_object", "semantic_fallback", "transcript_text", "audio_asr_text", "metadata_only",
]
CONTAMINATION_FLAGS = ["raw_text_not_committed", "manual_local_source_only", "not_gold", "not_training_ready"]
CLAIM_TERMS = ["alpha", "buy", "sell", "trading advice", "causal", "causality", "statistical significance", "significant at"]
MARKET_CLAIMS = [r"\bbuy\b", r"\bsell\b", r"\bshort\b", r"\btrade\b|\btrading\b", r"\balpha\b", r"\bcausal\b", r"statistical\s+significance", r"live\s+execution"]
CLAIM_ERRORS = {
    "NO_CAUSAL_CLAIM": ["causal", "causes"], "NO_SIGNIFICANCE_CLAIM": ["statistical significance", "statistically significant"], "NO_TRADING_CLAIM": ["alpha", "buy", "sell", "trading"],
}
DISCLAIMERS = ["NOT_ENOUGH_DATA", "EXPLORATORY_ONLY", "NO_SIGNIFICANCE_CLAIM", "NO_CAUSAL_CLAIM", "NO_TRADING_CLAIM"]
TRANSCRIPT_LIKE = [r"\b(operator|management|analyst|speaker|executive|ir)\s*:", r"\b(raw transcript|transcript|chunk|payload)\s+text\s+(excerpt|snippet|payload|content)", r"\bretrieval payload\b"]
RAW_FIELDS = ["evidence_text", "raw_text", "text", "snippet", "quote", "final_evidence_text"]


def col(df: DataFrame, name: str) -> Column:
    """The column, or null where the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return F.coalesce(T.strip(col(df, name).cast("string")), F.lit(""))


def filled(df: DataFrame, fields: list[str]) -> dict[str, Column]:
    return {f"missing_{f}": text_of(df, f) != "" for f in fields}


def hashes(df: DataFrame, fields: list[str], whole: bool = False) -> dict[str, Column]:
    return {f"bad_{f}": text_of(df, f).rlike(SHA if whole else r"^sha256:") for f in fields}


def flags(df: DataFrame) -> Column:
    """The contamination flags, an array or text joined by semicolons."""
    kind = dict(df.dtypes).get("contamination_flags")
    none = F.array().cast("array<string>")
    if kind is None:
        return none
    return F.coalesce(F.col("contamination_flags") if kind.startswith("array") else F.split("contamination_flags", ";"), none)


def unique(df: DataFrame, field: str) -> Column:
    """Whether a filled value comes once."""
    t = text_of(df, field)
    return (t == "") | (F.count(F.lit(1)).over(Window.partitionBy(t)) == 1)


def market_claims(c: Column) -> Column:
    """Patterns of market claims in a text, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(p)) for p in MARKET_CLAIMS)))


def claim_language(c: Column) -> Column:
    """Sorted codes of claims that a text makes, its disclaimers apart."""
    low = reduce(lambda t, d: F.replace(t, F.lit(d.lower()), F.lit("")), DISCLAIMERS, F.lower(F.coalesce(c, F.lit(""))))
    return F.array_compact(F.array(*(F.when(T.any_phrase(low, words), F.lit(code)) for code, words in CLAIM_ERRORS.items())))


def transcript_like(c: Column) -> Column:
    return T.any_pattern(F.lower(F.coalesce(c, F.lit(""))), TRANSCRIPT_LIKE)


def turn_candidate(df: DataFrame) -> dict[str, Column]:
    """Candidates of the turn extractor."""
    have = flags(df)
    return {
        **filled(df, ["candidate_id", "case_id", "signal_type", "suggested_label", "suggested_direction", "suggested_confidence", "evidence_span_ref", "source_file", "transcript_section", "speaker_role", "rule_id", "rule_version", "text_hash", "review_status", "created_at", "extractor_version"]),
        "bad_signal_type": col(df, "signal_type").isin(SIGNAL_TYPES), **hashes(df, ["provenance_hash", "source_sha256"]), **{f"no_flag_{f}": F.array_contains(have, f) for f in CONTAMINATION_FLAGS},
        "raw_text": F.lit("evidence_text" not in df.columns), "gold_status": col(df, "gold_status") == "not_gold",
    }


def extracted_candidate(df: DataFrame) -> dict[str, Column]:
    """Candidates of retrieval objects: label, states, hashes, and no text that reads like evidence."""
    raw = [f for f in ("evidence_text", "raw_text", "text", "snippet", "quote") if f in df.columns]
    like = r"(?i)\b(?:guidance|outlook|revenue|margin|question|answer|operator)\b"
    return {
        "bad_label": col(df, "label").isin(CANDIDATE_LABELS), "gold_status": col(df, "gold_status") == "not_gold", "review_status": col(df, "review_status") == "pending_human_review",
        "raw_text_or_commit": (col(df, "raw_text_committed") == "false") & (col(df, "commit_allowed") == "false"), **hashes(df, ["source_sha256", "normalized_transcript_sha256", "text_hash", "provenance_hash"]),
        **{f"raw_{f}": ~F.coalesce(F.col(f).cast("string").rlike(like), F.lit(False)) for f in raw},
    }


def review_candidate(df: DataFrame) -> dict[str, Column]:
    """Candidates for review: ids once, states, hashes, a reference to evidence, no raw text, no claims.

    References to other tables are checked by operators.orphans or with_known()."""
    said = F.lower(F.concat_ws(" ", *(text_of(df, f) for f in ("rule_id", "suggested_label", "contamination_flags", "review_status", "gold_status") if not dict(df.dtypes).get(f, "").startswith("array"))))
    return {
        **filled(df, ["candidate_id"]), "duplicate_candidate_id": unique(df, "candidate_id"), "bad_suggested_label": col(df, "suggested_label").isin(CANDIDATE_LABELS), "gold_status": col(df, "gold_status") == "not_gold",
        "review_status": col(df, "review_status") == "pending_human_review", **{f"{f}_must_be_false": col(df, f).cast("string") == "false" for f in ("raw_text_committed", "commit_allowed", "training_allowed")},
        **hashes(df, ["source_sha256", "normalized_transcript_hash", "text_hash", "provenance_hash"]), **filled(df, ["source_path"]),
        "no_evidence_or_chunk": (text_of(df, "evidence_object_id") != "") | (text_of(df, "chunk_id") != ""), **{f"raw_{f}": F.lit(f not in df.columns) for f in RAW_FIELDS},
        "external_dataset": ~F.lower(F.concat_ws(" ", text_of(df, "source_type"), text_of(df, "object_type"))).contains("external_dataset"),
        "forbidden_claim": ~said.rlike("|".join(rf"\b{t}\b" for t in CLAIM_TERMS)),
    }


def with_known(df: DataFrame, known: DataFrame, field: str) -> DataFrame:
    """Adds <field>_known: whether a filled value is among the keys of ``known``."""
    keys = known.select(F.col(known.columns[0]).alias("_k")).distinct().withColumn("_has", F.lit(True))
    j = df.join(keys, F.col(field) == F.col("_k"), "left")
    return j.withColumn(f"{field}_known", F.coalesce("_has", F.lit(False)) | (F.coalesce(F.col(field), F.lit("")) == "")).drop("_k", "_has")


def promotion(df: DataFrame) -> dict[str, Column]:
    """Rows for promotion to gold: adjudicated, attributed, once, and no mere suggestion of a machine."""
    have = flags(df)
    same = (text_of(df, "suggested_label") == text_of(df, "final_label")) & (text_of(df, "reviewer_rationale") == "") & (text_of(df, "rationale") == "")
    true = lambda f: col(df, f).cast("string") == "true"
    return {
        **filled(df, ["label_id", "case_id", "final_label", "review_status", "gold_status", "reviewer", "reviewed_at", "evidence_text", "source_file", "provenance_hash", "adjudicator", "adjudicated_at"]),
        "review_status": col(df, "review_status") == "adjudicated", "gold_status": col(df, "gold_status") == "promotion_candidate", "external_dataset": ~col(df, "source_type").eqNullSafe(F.lit("external_dataset")),
        "weak_label_only": ~(F.array_contains(have, "weak_label_only") | F.coalesce(true("weak_label_only"), F.lit(False))), "unresolved_flags": ~F.exists(have, lambda x: x.startswith("unresolved")),
        "no_human_label": ~F.coalesce(true("machine_suggestion_only"), F.lit(False)) | (text_of(df, "human_final_label") != ""), "no_rationale": ~same,
        "duplicate_label_id": unique(df, "label_id"), "duplicate_provenance_hash": unique(df, "provenance_hash"), "bad_provenance_hash": (text_of(df, "provenance_hash") == "") | text_of(df, "provenance_hash").rlike("^sha256:"),
    }


def chunk_manifest(df: DataFrame) -> dict[str, Column]:
    return {"bad_chunk_type": col(df, "chunk_type").isin(CHUNK_TYPES), "raw_text_committed": col(df, "raw_text_committed").cast("string") == "false", **hashes(df, ["source_sha256", "text_sha256"], whole=True)}


def retrieval_object(df: DataFrame) -> dict[str, Column]:
    """Metadata of retrieval objects: ids, hashes, spans in order, nothing included."""
    return {
        "bad_object_id": text_of(df, "object_id").rlike(r"^rom_(?:semantic|event|evidence)_[0-9a-f]{16}$"), **filled(df, ["case_id", "source_type", "provenance_ref", "rights_tier"]),
        **hashes(df, ["source_hash", "text_hash", "normalized_transcript_hash", "provenance_hash"], whole=True),
        "span_order": col(df, "span_start_char").isNull() | col(df, "span_end_char").isNull() | (col(df, "span_start_char").cast("long") <= col(df, "span_end_char").cast("long")),
        **{f"{f}_must_be_false": col(df, f).cast("string") == "false" for f in ("content_included", "embeddings_included", "vector_db_included")}, "duplicate_object_id": unique(df, "object_id"),
    }


def retrieval_result(df: DataFrame) -> dict[str, Column]:
    """Rows of a retrieval: abstentions have rank 0 and may lack ids, others are ranked, attributed and claim nothing."""
    quits = col(df, "retrieval_method") == "abstain"
    rank = col(df, "result_rank").cast("int")
    need = ["object_id", "case_id", "ticker", "fiscal_period"]
    return {
        **filled(df, ["query_id", "section_label", "speaker_role"]), "raw_text_returned": col(df, "raw_text_returned").cast("string") == "false", "rank": F.when(quits, rank == 0).otherwise(rank >= 1),
        **{f"missing_{f}": quits | (text_of(df, f) != "") for f in need}, **{f"bad_{f}": quits | text_of(df, f).rlike(SHA) for f in ("source_hash", "normalized_transcript_hash", "provenance_hash")},
        "claims": quits | (F.size(market_claims(col(df, "notes"))) == 0), "raw_text": ~transcript_like(col(df, "notes")),
    }


def evaluation_query(df: DataFrame) -> dict[str, Column]:
    """Queries of an evaluation: abstentions expect nothing, others expect something and claim nothing."""
    quits, control = (F.coalesce(col(df, f).cast("boolean"), F.lit(False)) for f in ("abstention_expected", "negative_control"))
    n = F.size(F.coalesce(col(df, "expected_evidence_ids") if "expected_evidence_ids" in df.columns else F.lit(None).cast("array<string>"), F.array().cast("array<string>")))
    return {
        **filled(df, ["query_id", "query_text", "query_intent"]), "control_must_abstain": ~control | quits, "abstention_expects": ~(quits | control) | (n == 0), "expects_nothing": quits | control | (n > 0),
        "claims": quits | control | (F.size(market_claims(F.concat_ws(" ", text_of(df, "query_text"), text_of(df, "notes")))) == 0), "raw_text": ~transcript_like(col(df, "query_text")),
    }


def benchmark(df: DataFrame) -> dict[str, Column]:
    """Entries of a benchmark registry: none writes gold or claims quality; external ones are for benchmarks only."""
    ext = F.coalesce(col(df, "benchmark_group") == "external_dataset", F.lit(False))
    false = lambda f: col(df, f).cast("string") == "false"
    return {
        **filled(df, ["benchmark_id", "benchmark_group", "status", "default_use", "minimum_gold_labels"]), "external_use": ~ext | (col(df, "default_use") == "benchmark_only"), "external_training": ~ext | false("training_allowed"),
        **{f: false(f) for f in ("writes_gold", "weak_labels_can_be_gold", "production_ml_claim_allowed")},
    }


def reviewed_row(df: DataFrame, labels: list[str]) -> dict[str, Column]:
    """Reviewed rows for export: a final state, a known label, ids, text and a reviewer."""
    state = F.lower(F.coalesce(F.nullif(text_of(df, "review_state"), F.lit("")), text_of(df, "status")))
    kind = dict(df.dtypes).get("labels", "string")
    given = F.coalesce(F.col("labels"), F.array().cast("array<string>")) if kind.startswith("array") else F.split(text_of(df, "labels"), ";")
    return {"not_reviewed": state.isin("reviewed", "approved"), "no_label": F.exists(given, lambda x: F.trim(x).isin(labels)), **filled(df, ["case_id", "chunk_id", "text", "reviewer"])}


def gold_status(df: DataFrame) -> Column:
    """The status of a gold row, the first that holds: duplicates, external sources, contamination, no provenance, missing
    evidence, reviewer, source or other fields, an unknown signal, VALID."""
    have = flags(df)
    need = ["case_id", "label_id", "signal_type", "direction", "speaker_role"]
    lacks = lambda *fs: reduce(lambda a, b: a | b, (text_of(df, f) == "" for f in fs))
    return (
        F.when(~unique(df, "label_id"), "BLOCKED_DUPLICATE").when(col(df, "source_type").eqNullSafe(F.lit("external_dataset")), "BLOCKED_EXTERNAL_SOURCE")
        .when(F.array_contains(have, "weak_label_only") | F.exists(have, lambda x: x.startswith("unresolved")), "BLOCKED_CONTAMINATION_RISK").when(~text_of(df, "provenance_hash").rlike("^sha256:"), "BLOCKED_NO_PROVENANCE")
        .when(lacks("evidence_text", "reviewer", "reviewed_at", "source_file"), "REPAIRABLE_REVIEW_REQUIRED").when(lacks(*need) | ~F.coalesce(col(df, "signal_type").isin(SIGNAL_TYPES), F.lit(False)), "REPAIRABLE_SCHEMA_ONLY").otherwise("VALID")
    )
