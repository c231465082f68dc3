"""Closed value sets, folders and record types."""
from __future__ import annotations

from pyspark.sql import types as T

# The closed sets of the data model.
CLAIM_TYPES = ("technical_fact", "person_claim", "opinion", "hypothesis", "decision", "observation", "instruction",
               "misconception")
CLAIM_STATUSES = ("unverified", "verified", "attributed", "opinion", "partially_true", "accepted_for_now", "disputed",
                  "outdated", "deprecated", "rejected")
SENSITIVITIES = ("personal", "work", "confidential")
PAGE_TYPES = ("concept", "pattern", "glossary", "comparison", "misconception")
LEVELS = ("unknown", "seen", "explained", "used", "reviewed", "can-teach")
TRIAGE_DECISIONS = ("drop", "keep-as-link", "deep")
CITABLE = ("verified", "attributed", "accepted_for_now", "partially_true")
ID_PREFIXES = ("source", "claim", "session", "decision", "learning")
REVIEW_DAYS = (1, 3, 7, 16, 35)

STATUS_FOLDER = {
    "unverified": "pending", "partially_true": "pending", "accepted_for_now": "pending",
    "verified": "verified", "disputed": "disputed", "rejected": "rejected",
    "attributed": "attributed", "opinion": "attributed",
    "outdated": "outdated", "deprecated": "outdated",
}
PAGE_FOLDER = {"concept": "Concepts", "pattern": "Patterns", "glossary": "Glossary", "comparison": "Comparisons",
               "misconception": "Misconceptions"}

# The folders of a corpus in scan order.
CORPUS_ROOTS = ("00_Inbox", "01_Projects", "02_Areas", "03_Resources", "10_Claims", "30_Learning")
METADATA_ROOT = "06_Metadata"
SHARED_ROOTS = ("03_Resources", "30_Learning")

_S = T.StringType()
_L = T.ArrayType(_S)


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


CORPUS = _struct(path=_S, root=_S, doc_ord=_S, text=_S, meta=T.MapType(_S, _S), lists=T.MapType(_S, _L), body=_S,
                 corrupt=T.BooleanType())
CLIPS = _struct(path=_S, ord=T.LongType(), origin=_S, url=_S, title=_S, sensitivity=_S, text=_S)
COMMANDS = _struct(claim_id=_S, seq=T.LongType(), cmd=_S, target=_S, evidence=_L, new_text=_S, new_quote=_S, reason=_S,
                   superseded_by=_S, claim_type=_S, sensitivity=_S, speaker=_S, source_refs=_L, proposed_status=_S,
                   date=T.DateType())
REVIEWS = _struct(learning_id=_S, seq=T.LongType(), date=T.DateType(), passed=T.BooleanType())
