"""State as DataFrames: upserts, deletes, versions, queues, ledgers, candidates, provenance.

There is no table format with transactions here, so a change is a new snapshot from the old one and
the changes; logs are append-only with views of their latest state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Allowed document states and what may follow each.
TRANSITIONS = {"uploaded": ("queued", "deleted"), "queued": ("processing", "failed", "deleted"), "processing": ("ready", "partial", "failed", "deleted"), "partial": ("processing", "ready", "deleted"), "ready": ("processing", "deleted"), "failed": ("queued", "deleted"), "deleted": ("ready",)}


def latest(log: DataFrame, key: tuple[str, ...], *order: Column) -> DataFrame:
    """The last row per key."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(current: DataFrame, changes: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """current with rows of changes in place of, or beside, those of the same key (K1, K4, K7)."""
    new = changes if order is None else latest(changes, key, F.desc(order))
    return current.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(current: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """current and those rows whose key it has not (K6, K8)."""
    return current.unionByName(rows.dropDuplicates(list(key)).join(current.select(*key), list(key), "left_anti"))


def soft_delete(rows: DataFrame, which: Column, at: Column) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def restore(rows: DataFrame, which: Column) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(which, F.lit(None)).otherwise(F.col("deleted_at")))


def purge(rows: DataFrame, as_of: Column, hours: int) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): rows deleted over so many hours ago go (K3)."""
    old = F.coalesce(F.unix_timestamp("deleted_at") < F.unix_timestamp(as_of) - hours * 3600, F.lit(False))
    return rows.where(~old), rows.where(old)


def drop_stale(current: DataFrame, retained: DataFrame, key: tuple[str, ...], within: tuple[str, ...]) -> DataFrame:
    """Of the groups in retained only the retained keys stay (K5, U4)."""
    stale = current.join(retained.select(*within).distinct(), list(within), "left_semi").join(retained, list(key), "left_anti").select(*key)
    return current.join(stale, list(key), "left_anti")


def rename_slug(links: DataFrame, old: str, new: str) -> DataFrame:
    swap = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return links.select(*(swap(c) if c in ("from_slug", "to_slug", "slug") else F.col(c) for c in links.columns))


def snapshot_diff(current: DataFrame, previous: DataFrame, path: str = "item_path", digest: str = "sha256") -> DataFrame:
    """item_path, action: new, unchanged, changed or missing."""
    c, p = current.select(path, F.col(digest).alias("now")), previous.select(path, F.col(digest).alias("was"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("was"), "unchanged").otherwise("changed")
    return c.join(p, path, "full_outer").select(path, action.alias("action"))


def delete_policy(diff: DataFrame, policy: Column) -> DataFrame:
    """What becomes of missing items: soft_delete, mark_only, or nothing."""
    return diff.withColumn("effect", F.when(F.col("action") != "missing", "none").when(policy == "soft_delete", "deleted").when(policy == "mark_only", "marked").otherwise("none"))


def begin_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """doc_id, content_hash, version_id, reused: a ready version of the same content is used again."""
    ready = versions.where("status = 'ready'").groupBy("doc_id", "content_hash").agg(F.max("version_id").alias("found"))
    last = versions.groupBy("doc_id").agg(F.max("version_id").alias("last"))
    r = requests.join(ready, ["doc_id", "content_hash"], "left").join(last, "doc_id", "left")
    return r.select("doc_id", "content_hash", F.coalesce("found", F.coalesce("last", F.lit(0)) + 1).alias("version_id"), F.col("found").isNotNull().alias("reused"))


def activate(versions: DataFrame) -> DataFrame:
    """The newest built version of each document is ready, older ones are retired."""
    w = Window.partitionBy("doc_id").orderBy("version_id")
    return versions.withColumn("superseded_by", F.lead("version_id").over(w)).withColumn("status", F.when(F.col("superseded_by").isNull(), "ready").otherwise("retired"))


def retired_for_cleanup(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Retired versions that no job cleans yet."""
    return versions.where("status = 'retired'").join(jobs.select("version_id"), "version_id", "left_anti")


def may_follow(now: Column, to: Column) -> Column:
    """Whether a document may go from one state to another."""
    out = F.lit(False)
    for state, then in TRANSITIONS.items():
        out = out | ((now == state) & to.isin(*then))
    return out


def next_jobs(jobs: DataFrame, most: int, kind: str | None = None) -> DataFrame:
    """The pending jobs to claim: highest priority, then oldest."""
    j = jobs.where("status = 'pending'")
    j = j if kind is None else j.where(F.col("job_type") == kind)
    return j.orderBy(F.desc("priority"), "created_at", "id").limit(most)


def after_failure(attempts: Column, most: Column) -> Column:
    return F.when(attempts < most, "pending").otherwise("failed")


def admit(events: DataFrame, cap: float) -> DataFrame:
    """scope, day, id, amount, admitted: reservations in order of id while the sum stays within the cap.

    A refused reservation does not count, so each decision needs the one before: rows are dealt by scope and
    day, sorted (with spill) and streamed, and a day of any size needs the memory of one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, 0.0
        for pdf in batches:
            out = []
            for scope, day, x in zip(pdf["scope"], pdf["day"], pdf["amount"]):
                if (scope, day) != key:
                    key, total = (scope, day), 0.0
                out.append(total + x <= cap)
                total += x if out[-1] else 0.0
            yield pdf.assign(admitted=out)

    rows = events.select("scope", "day", "id", "amount").repartition("scope", "day").sortWithinPartitions("scope", "day", "id")
    return rows.mapInPandas(run, "scope string, day date, id long, amount double, admitted boolean")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts with bars between."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def new_candidates(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates whose fingerprint is not pending, accepted or applied already."""
    open_ = current.where(F.col("status").isin("pending", "accepted", "applied")).select("fingerprint")
    return rows.dropDuplicates(["fingerprint"]).join(open_, "fingerprint", "left_anti").withColumn("status", F.lit("pending"))


def promotion_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, candidate_type, payload, confidence, risk from (doc_id, summary, keywords, entities, dates, links)."""
    one = lambda c, kind, conf, risk: docs.select("doc_id", F.lit(kind).alias("candidate_type"), F.col(c).alias("payload"), F.lit(conf).alias("confidence"), F.lit(risk).alias("risk")).where("payload is not null and payload <> ''")
    many = lambda c, kind, conf, risk: docs.select("doc_id", F.lit(kind).alias("candidate_type"), F.explode(c).alias("payload"), F.lit(conf).alias("confidence"), F.lit(risk).alias("risk"))
    return one("summary", "summary", 0.8, "low").union(many("keywords", "fact", 0.7, "low")).union(many("entities", "entity", 0.75, "medium")).union(many("dates", "timeline", 0.6, "medium")).union(many("links", "link", 0.5, "low")).union(one("summary", "fact", 0.6, "medium"))


def batch_apply(candidates: DataFrame, risk: str | None = None, dry_run: bool = False) -> DataFrame:
    """Accepted candidates, of one risk if given, are applied."""
    due = (F.col("status") == "accepted") & (F.lit(True) if risk is None else F.col("risk") == risk)
    return candidates.withColumn("effect", F.when(due, "would_apply" if dry_run else "applied").otherwise("kept")).withColumn("status", F.when(due & F.lit(not dry_run), "applied").otherwise(F.col("status")))


def put_resolution(existing: Column, same: Column, conflict: Column, force: Column) -> Column:
    """created, unchanged, conflict or updated."""
    return F.when(~existing, "created").when(same, "unchanged").when(conflict & ~force, "conflict").otherwise("updated")


def orphan_projections(projections: DataFrame, artifacts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Projections of no artifact that are older than so many days."""
    return projections.join(artifacts.select("artifact_id"), "artifact_id", "left_anti").where(F.datediff(as_of, F.col("updated_at")) > days)


def delete_impact(artifact: DataFrame, **children: DataFrame) -> DataFrame:
    """artifact_id and how many rows of each child table hang on it."""
    out = artifact.select("artifact_id")
    for name, rows in children.items():
        out = out.join(rows.groupBy("artifact_id").agg(F.count("*").alias(name)), "artifact_id", "left").fillna(0, [name])
    return out


def restore_staled(projections: DataFrame, artifact_ids: DataFrame, reason: str) -> DataFrame:
    """Only what that delete made stale comes back."""
    back = projections.join(artifact_ids.withColumn("__back", F.lit(True)), "artifact_id", "left")
    hit = F.coalesce("__back", F.lit(False)) & (F.col("status") == "stale") & F.coalesce(F.col("stale_reason") == reason, F.lit(False))
    return back.withColumns({"status": F.when(hit, "active").otherwise(F.col("status")), "stale_reason": F.when(hit, F.lit(None)).otherwise(F.col("stale_reason"))}).drop("__back")


def feedback(rows: DataFrame) -> DataFrame:
    """Ratings held within 0 and 5; none stays none."""
    return rows.withColumn("rating", F.when(F.col("rating").isNotNull(), F.least(F.lit(5), F.greatest(F.lit(0), F.col("rating")))))


def failure_patterns(log: DataFrame) -> DataFrame:
    """operation, pattern, n: errors by the first twelve digits of their hash."""
    return log.groupBy("operation", F.substring(F.sha2("error", 256), 1, 12).alias("pattern")).agg(F.count("*").alias("n"), F.min("error").alias("example"))


def backup(tables: dict[str, DataFrame], folder: str) -> str:
    """Each table as Parquet under folder, and a manifest of their row counts."""
    counts = {}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{folder}/{name}.parquet").count()
    spark.createDataFrame([(json.dumps(counts),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return folder


def read_backup(spark, folder: str) -> dict[str, DataFrame]:
    """The tables of a backup; an error if one is missing or has not the rows that the manifest counts."""
    counts = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in counts}
    wrong = {name: n for name, df in tables.items() if (n := df.count()) != counts[name]}
    if wrong:
        raise ValueError(f"{folder} is not whole: rows {wrong}, of {({name: counts[name] for name in wrong})} in its manifest")
    return tables
