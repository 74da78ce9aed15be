"""The audit as one job: duplicates, groups, counters and blockers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from splitwarden.operators import audit as A
from splitwarden.operators import exact as EX
from splitwarden.operators import near as NE
from splitwarden.operators.scale import materialise
from splitwarden.sources.files import build_inventory


@dataclass(frozen=True)
class Audit:
    exact_edges: DataFrame
    near_edges: DataFrame
    manifest: DataFrame
    summary: DataFrame
    blockers: DataFrame


def run_audit(
    records: DataFrame,
    classes: DataFrame,
    threshold: int,
    review: DataFrame | None = None,
    auto: bool = True,
    bits: int = NE.HASH_BITS,
) -> Audit:
    """Audit numbered records.

    Without a review and with ``auto``, near duplicates are grouped and counted from the
    distinct hashes alone and no pair is listed. With a review, all pairs of records are listed,
    because decisions are made on them.
    """
    records = materialise(records, "records")
    readable = records.filter("readable")
    exact_links = EX.exact_edges(readable)
    if review is None and auto:
        links = NE.near_hash_links(readable, threshold, bits=bits)
        near_links = NE.auto_edges(readable, threshold, links)
        counts = A.auto_decision_counts(NE.near_pair_totals(readable, threshold, links))
    else:
        pairs = NE.near_duplicates(readable, threshold, bits=bits)
        pairs = materialise(pairs.drop("path_1", "path_2", "sha256_1", "sha256_2"), "pairs")
        pairs = NE.record_pairs(pairs, readable).drop("n_pairs")
        if review is not None:
            pairs = NE.apply_review(pairs, review)
        else:
            pairs = pairs.selectExpr("*", "'' AS decision", "'' AS notes")
        if auto:
            pairs = NE.auto_group(pairs, threshold)
        pairs = materialise(pairs, "reviewed")
        near_links = NE.confirmed_edges(pairs)
        counts = A.decision_counts(pairs)
    manifest = materialise(A.group_manifest(readable, exact_links, near_links), "manifest")
    summary = A.audit_summary(
        build_inventory(records),
        EX.exact_summary(EX.content_groups(readable)),
        counts,
        manifest,
        classes,
    )
    return Audit(exact_links, near_links, manifest, summary, A.audit_gate(summary))
