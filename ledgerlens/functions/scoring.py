"""Scores, budgets and hashes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fusion weights of the candidate generators, and the fusion constant.
RRF_K = 60
RRF_WEIGHTS = {"exact_key": 1.6, "active_constraint": 1.5, "fts5_bm25": 1.0, "semantic": 0.8, "recent_session": 0.6, "graph": 0.8}
#: Weights of the linear feature score, and the selection rule.
FEATURE_WEIGHTS = {"fused": 1.0, "relevance": 0.2, "scope": 0.16, "temporal": 0.18, "authority": 0.14, "confidence": 0.16, "importance": 0.14, "evidence": 0.1, "recency": 0.04, "graph": 0.05}
SELECT_AT, SELECT_LIMIT = 0.18, 8
#: Proximity of scopes (session, project, workspace, other).
SCOPE_PROXIMITY = {"session": 1.0, "project": 0.85, "workspace": 0.65}


def _num(x: float) -> Column:
    return F.lit(float(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0, an error where sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), _num(0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.when(norms == 0, _num(0)).otherwise(dot(a, b) / norms))
    return same.otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def character_embedding(text: Column, buckets: int = 16) -> Column:
    """Counts of lower-cased characters by code point modulo the bucket number."""
    codes = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("long") % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(codes, lambda c: c == b)).cast("double"))


def rrf_term(generator: Column, rank: Column) -> Column:
    weight = reduce(lambda w, g: w.when(generator == g, _num(RRF_WEIGHTS[g])), RRF_WEIGHTS, F.when(F.lit(False), _num(0))).otherwise(_num(1))
    return weight / (rank + _num(RRF_K))


def feature_score(**features: Column) -> Column:
    """The weighted sum of the named features, rounded to 6 places; features left out count as 0."""
    return F.round(reduce(lambda s, k: s + features[k] * FEATURE_WEIGHTS[k], features, _num(0)), 6)


def scope_proximity(scope: Column) -> Column:
    return F.when(scope == "session", 1.0).when(scope == "project", 0.85).when(scope == "workspace", 0.65).otherwise(0.4)


def authority_score(authority: Column) -> Column:
    return F.when(authority == "user_explicit", 1.0).when(authority == "system_instruction", 0.95).when(authority == "tool_observation", 0.8).when(authority == "assistant_claim", 0.35).otherwise(0.55)


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")


def valid_time_label(since: Column, until: Column, current: Column) -> Column:
    """current, or the time from or until which a fact holds or held."""
    tense = F.when(current, "current").otherwise("historical")
    return F.when(until.isNotNull(), F.concat(F.lit("historical until "), until)).when(since.isNotNull(), F.concat(tense, F.lit(" from "), since)).otherwise(tense)


def temporal_score(is_open: Column, has_filter: Column, in_range: Column) -> Column:
    """1 for a current version and 0.35 for a closed one; with a filter 1 in range, 0.8 open, 0.45 otherwise."""
    return F.when(~has_filter, F.when(is_open, 1.0).otherwise(0.35)).when(in_range, 1.0).when(is_open, 0.8).otherwise(0.45)


def backoff(retries: Column, base: int = 10, cap: int = 900) -> Column:
    return F.least(F.lit(cap), (base * F.pow(F.lit(2.0), F.least(retries, F.lit(30)))).cast("long"))


def attachment_budget(window: Column, ratio: float, caps: list[int], least: int) -> Column:
    """The smallest cap or window share; 0 below the least useful size."""
    budget = F.least(F.floor(window * ratio), *(F.lit(c).cast("long") for c in caps))
    return F.when(budget < least, F.lit(0).cast("long")).otherwise(budget)


def positional_score(position: Column, step: float = 0.04, least: float = 0.1) -> Column:
    """1 - step * position (from 0), not below the least."""
    return F.greatest(_num(least), 1 - step * position.cast("double"))


def evidence_score(labels: Column, stage: Column, importance: Column) -> Column:
    return F.least(_num(0.96), 0.48 + 0.12 * labels + 0.24 * stage) + F.least(_num(0.05), 0.05 * importance)


def confidence(authority: Column, explicit: Column, evidence: Column, temporal: Column) -> Column:
    total = 0.45 + authority + F.when(explicit, 0.15).otherwise(0.0) + F.when(evidence, 0.1).otherwise(0.0) + F.when(temporal, 0.03).otherwise(0.0)
    return F.round(F.greatest(_num(0), F.least(_num(1), total)), 3)


def call_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    return F.bround((tokens_in * rate_in + tokens_out * rate_out) / 1000, 8)


def identity(*parts: Column) -> Column:
    """A stable hash of named parts: sha256 of their JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
