"""Record types, their fixed values, and relevance weights."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Fixed values of the data model.
MEMORY_TYPES = ("rule", "fact", "episode", "procedure", "preference")
SCOPES = ("permanent", "project", "session", "ttl")
VISIBILITIES = ("private", "shared", "sensitive")
ENTITY_TYPES = ("person", "project", "system", "decision", "concept")
CONFLICT_STATUSES = ("", "active", "resolved")
RELATIONS = (
    "WORKS_AT", "HAS_ROLE", "LOCATED_IN", "MARRIED_TO", "REPORTS_TO", "EMPLOYED_BY", "LIVES_IN", "BASED_IN", "CEO_OF", "LEADS",
    "USES", "DEPENDS_ON", "DECIDED_TO", "KNOWS", "HAS_SKILL", "PART_OF", "COLLABORATES_WITH", "IMPLEMENTS", "MANAGES", "RELATES_TO",
)

_s, _l, _d, _t, _i = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.IntegerType()
_strings, _floats = T.ArrayType(_s), T.ArrayType(T.FloatType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


MEMORY = _struct(
    id=_s, type=_s, scope=_s, visibility=_s, content=_s, confidence=_d, source=_s, tags=_strings, project=_s, user_id=_s, ttl_seconds=_l,
    created_at=_t, updated_at=_t, last_accessed=_t, access_count=_l, reinforced_at=_t, reinforced_count=_i, metadata=_s, supersedes_id=_s,
    valid_until=_t, valid_from=_t, valid_to=_t, conflict_group_id=_s, conflict_status=_s, embedding=_floats,
)
ENTITY = _struct(id=_s, name=_s, type=_s, aliases=_strings, memory_ids=_strings, created_at=_t, updated_at=_t, metadata=_s, project=_s, summary=_s, name_embedding=_floats, community_id=_l)
FACT = _struct(
    id=_s, source_entity_id=_s, target_entity_id=_s, relation_type=_s, fact=_s, fact_embedding=_floats, created_at=_t, expired_at=_t, valid_at=_t,
    invalid_at=_t, source_memory_ids=_strings, episodes=_strings, confidence=_d,
)
EPISODE = _struct(uuid=_s, session_id=_s, user_msg=_s, assistant_msg=_s, captured_at=_t, memory_ids=_strings, fact_ids=_strings)
WAL = _struct(id=_s, memory_id=_s, content=_s, project=_s, session_id=_s, enqueued_at=_t, attempts=_i, state=_s, error=_s, updated_at=_t)


@dataclass(frozen=True)
class Weights:
    """Shares of the relevance factors in the final score."""

    similarity: float = 0.45
    recency: float = 0.08
    frequency: float = 0.05
    type_boost: float = 0.10
    scope_boost: float = 0.08
    confidence: float = 0.07
    reinforcement: float = 0.07
    tag_affinity: float = 0.05
    graph_proximity: float = 0.05

    def checked(self) -> Weights:
        """These weights if none is negative and they sum to 1 (by 0.01), else the defaults."""
        values = [getattr(self, f.name) for f in fields(self)]
        return self if min(values) >= 0 and abs(sum(values) - 1) <= 0.01 else Weights()
