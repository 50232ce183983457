"""Queries over the ledger tables (versions, links, sources, branches, commits).

Lists that may grow with a key's history are returned as ordered rows, never as one
array per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimweave.functions.scores import as_score, exact, scaled_score, windows_overlap
from claimweave.functions.text import canonical_text
from claimweave.operators import intervals as I
from claimweave.operators.ledger import branch_ancestry
from claimweave.plans.ordered import numbered, with_previous
from claimweave.plans.session import materialise, sized_broadcast

KEY = ["claim_key", "version_id"]
CURRENT = ("active", "hypothetical")


def is_current(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*CURRENT)


# -- scores ------------------------------------------------------------------

def evidence_totals(versions: DataFrame, links: DataFrame, sources: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """Per version: counts and exact trust totals (units of 1e-4) of its active edges.

    ``links`` are either all edges, or the direct ones with ``inherited`` giving the sums of the rest.

    A missing source counts with trust 0.5.  A version that never had a support edge
    is carried by its own source.
    """
    trust = sources.select("source_id", exact(F.col("trust_score")).alias("trust"))
    half = F.lit(5000).cast("long")
    edge = links.join(trust, "source_id", "left").withColumn("trust", F.coalesce("trust", half))
    live = F.col("status") == "active"
    support, opposition = F.col("relation") == "support", F.col("relation") == "opposition"
    zero = F.lit(0).cast("long")
    totals = edge.groupBy(*KEY).agg(
        F.count(F.when(support, 1)).alias("any_support"),
        F.count(F.when(support & live, 1)).alias("active_support_count"),
        F.count(F.when(opposition & live, 1)).alias("active_opposition_count"),
        F.coalesce(F.sum(F.when(support & live, F.col("trust"))), zero).alias("support_units"),
        F.coalesce(F.sum(F.when(opposition & live, F.col("trust"))), zero).alias("opposition_units"),
    )
    if inherited is not None:
        taken = inherited.where("status = 'active'").groupBy(*KEY).agg(F.sum("n").alias("more"), F.sum("trust").alias("more_units"))
        totals = totals.join(taken, KEY, "left").withColumns({
            "active_opposition_count": F.col("active_opposition_count") + F.coalesce("more", zero),
            "opposition_units": F.col("opposition_units") + F.coalesce("more_units", zero)}).drop("more", "more_units")
    own = trust.select("source_id", F.col("trust").alias("own_trust"))
    rows = versions.join(totals, KEY, "left").join(own, "source_id", "left")
    backed = F.when(F.coalesce("any_support", zero) == 0, F.coalesce("own_trust", half)).otherwise(F.col("support_units"))
    return rows.select(
        *versions.columns,
        F.coalesce("active_support_count", zero).alias("active_support_count"),
        F.coalesce("active_opposition_count", zero).alias("active_opposition_count"),
        F.coalesce("support_units", zero).alias("support_units"),
        F.coalesce("opposition_units", zero).alias("opposition_units"),
        scaled_score(backed - F.coalesce("opposition_units", zero), exact(F.col("confidence"))).alias("score_units"),
    )


def support_score(versions: DataFrame, links: DataFrame, sources: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """round(max(0, active support - active opposition) * confidence, 4) per version."""
    return evidence_totals(versions, links, sources, inherited).select(*KEY, as_score(F.col("score_units")).alias("score"))


def support_graph(versions: DataFrame, links: DataFrame, sources: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """Counts and trust totals per version; the edges themselves are ``link_detail``."""
    t = evidence_totals(versions, links, sources, inherited)
    return t.select(
        *KEY, F.col("source_id").alias("governing_source_id"),
        as_score(F.col("score_units")).alias("support_score"),
        as_score(F.col("support_units")).alias("active_support_trust_total"),
        as_score(F.col("opposition_units")).alias("active_opposition_trust_total"),
        as_score(F.greatest(F.lit(0).cast("long"), F.col("support_units") - F.col("opposition_units"))).alias("net_evidence_trust"),
        "active_support_count", "active_opposition_count")


# -- joins -------------------------------------------------------------------

def version_detail(versions: DataFrame, beliefs: DataFrame, sources: DataFrame, branches: DataFrame) -> DataFrame:
    """Version with its subject/predicate, governing source and branch name."""
    b = beliefs.select("claim_key", "subject", "predicate")
    s = sources.select("source_id", "source_ref", F.col("trust_score").alias("source_trust_score"))
    n = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    return versions.join(b, "claim_key", "left").join(s, "source_id", "left").join(n, "branch_id", "left")


def link_detail(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Edge with the fields of its source."""
    return links.join(sources.select("source_id", "source_type", "source_ref", "excerpt", "trust_score"), "source_id", "left")


def current_versions(versions: DataFrame, branches: DataFrame, branch_ids: DataFrame | None = None) -> DataFrame:
    """What each branch sees: its own current versions of a key, else those of the nearest ancestor with any.

    ``branch_ids`` (one column, branch_id) restricts the viewing branches.
    """
    up = branch_ancestry(branches, branch_ids)
    seen = sized_broadcast(up.withColumnRenamed("branch_id", "viewer_id"))  # versions are not shuffled by their few branches
    rows = versions.where(is_current()).join(seen, F.col("branch_id") == F.col("ancestor_id")).drop("ancestor_id")
    nearest = rows.groupBy("viewer_id", "claim_key").agg(F.min("depth").alias("depth"))
    return rows.join(nearest, ["viewer_id", "claim_key", "depth"])


#: Versions of a key from which on windows are met through blocks of days instead of a product.
MANY_WINDOWS = 256


def _split(df: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``df`` by keys of few and of many rows in ``other``, or None if no key has many."""
    many = materialise(other.groupBy("claim_key").agg(F.count("*").alias("n")).where(F.col("n") > MANY_WINDOWS).select("claim_key"), "busy-keys")
    if many.isEmpty():
        return None
    many = sized_broadcast(many)
    return df.join(many, "claim_key", "left_anti"), df.join(many, "claim_key", "left_semi")


def overlap_pairs(claims: DataFrame, current: DataFrame) -> DataFrame:
    """Claims against current versions of the same key whose windows overlap, with a same-object flag.

    Keys with many versions are joined through blocks of days, so windows that do not overlap never meet.
    """
    v = current.select(
        "claim_key", "version_id", F.col("normalized_object").alias("version_object"),
        F.col("valid_from").alias("version_from"), F.col("valid_to").alias("version_to"))

    def plain(c: DataFrame, v: DataFrame = v) -> DataFrame:
        return c.join(v, "claim_key").where(windows_overlap(F.col("version_from"), F.col("version_to"), F.col("valid_from"), F.col("valid_to")))

    parts = _split(claims, v)
    if parts is None:
        met = plain(claims)
    else:
        c_low, c_high = I.first_day(F.col("valid_from")), I.end_day(F.col("valid_to"))
        v_low, v_high = I.first_day(F.col("version_from")), I.end_day(F.col("version_to"))
        ahead = parts[1].where(c_low < c_high)
        started = I.holding(ahead, c_low, v, v_low, v_high, ["claim_key"])
        later = I.holding(v.where(v_low < v_high), v_low, ahead, c_low + 1, c_high, ["claim_key"])
        met = plain(parts[0])
        met = met.unionByName(started.select(met.columns)).unionByName(later.select(met.columns))
        # windows that end before they start may still meet open ones
        met = met.unionByName(plain(parts[1].where(c_low >= c_high))).unionByName(plain(ahead, v.where(v_low >= v_high)))
    return met.withColumn("same_object", F.col("version_object") == F.col("normalized_object"))


def truth_as_of(scored: DataFrame, as_of: DataFrame, branch_id: int | None = None) -> DataFrame:
    """Per (claim_key, as_of): the version whose window holds the date, best by (valid_from, score, id).

    Superseded versions count, retracted ones do not; all branches unless one is named. For keys with many versions the best
    version is kept per block of days, so a date costs a few lookups however many windows hold it.
    """
    pool = scored.where("status <> 'retracted'")
    if branch_id is not None:
        pool = pool.where(F.col("branch_id") == branch_id)
    value = F.struct("valid_from", "score_units", "version_id", "object_value", "status", "source_id")
    shown = ["claim_key", "as_of", "b.version_id", "b.object_value", "b.status", "b.source_id"]

    def plain(dates: DataFrame) -> DataFrame:
        held = pool.join(dates, "claim_key").where(windows_overlap(F.col("valid_from"), F.col("valid_to"), F.col("as_of"), F.col("as_of")))
        return held.groupBy("claim_key", "as_of").agg(F.max(value).alias("b")).select(*shown)

    asked = as_of.select("claim_key", "as_of").distinct()
    parts = _split(asked, pool)
    if parts is None:
        return plain(asked)
    low, high = I.first_day(F.col("valid_from")), I.end_day(F.col("valid_to"))
    best = I.best_holding(parts[1].where("as_of IS NOT NULL"), I.first_day(F.col("as_of")), pool, low, high, value, ["claim_key"])
    # an unknown date is held by every window
    unknown = plain(parts[1].where("as_of IS NULL"))
    return plain(parts[0]).unionByName(best.withColumnRenamed("best", "b").select(*shown)).unionByName(unknown)


def duplicate_sources(writes: DataFrame, sources: DataFrame, recent: int | None = None) -> DataFrame:
    """(staged_id, n_matches, source_id): how many stored sources the proposed excerpt repeats, and the newest of them.

    Counted per text first: a text stored a million times costs one group. ``recent`` looks at the newest only.
    """
    if recent is not None:
        sources = sources.orderBy(F.col("source_id").desc()).limit(recent)
    w = writes.select("staged_id", canonical_text(F.col("excerpt")).alias("excerpt_key")).where("excerpt_key <> ''")
    s = sources.select("source_id", canonical_text(F.col("excerpt")).alias("excerpt_key")).groupBy("excerpt_key").agg(F.count("*").alias("n_matches"), F.max("source_id").alias("source_id"))
    return w.join(s, "excerpt_key").select("staged_id", "n_matches", "source_id")


def rolled_back_match(claims: DataFrame, versions: DataFrame, links: DataFrame, sources: DataFrame, writes: DataFrame | None = None) -> DataFrame:
    """staged_id of writes that bring back rolled-back content, references or excerpts.

    ``claims`` have the content, ``writes`` the references and excerpts (the claims, where they have both). The references and
    excerpts of rolled-back sources are written without their repeats, so a few are sent to all workers and nothing is shuffled by text.
    """
    writes = claims if writes is None else writes
    dead = versions.where("status = 'retracted' AND rolled_back").select("claim_key", "normalized_object").distinct()
    content = claims.join(dead, ["claim_key", "normalized_object"], "left_semi").select("staged_id")
    gone = links.where("status = 'rolled_back'").select("source_id").distinct()
    tainted = sources.join(gone, "source_id", "left_semi").select("source_id", F.inline(F.array(
        F.struct(F.lit("ref").alias("kind"), F.col("source_ref").alias("said")), F.struct(F.lit("text").alias("kind"), F.col("excerpt").alias("said")))))
    said = tainted.select("kind", "said").distinct().select("kind", canonical_text(F.col("said")).alias("k")).where("k <> ''").distinct()
    said = materialise(said, "rolled-back-texts")
    by_ref = writes.withColumn("k", canonical_text(F.col("source_ref"))).join(said.where("kind = 'ref'"), "k", "left_semi").select("staged_id")
    by_text = writes.withColumn("k", canonical_text(F.col("excerpt"))).join(said.where("kind = 'text'"), "k", "left_semi").select("staged_id")
    return content.unionByName(by_ref).unionByName(by_text).distinct()


def source_node_rollup(sources: DataFrame, evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Per source: how many evidence rows and versions it has, lineage and quarantine flags."""
    e = evidence.groupBy("source_id").agg(F.count("*").alias("evidence_count"))
    lineage = F.col("supersedes_id").isNotNull() | F.col("status").isin("superseded", "retracted")
    v = versions.groupBy("source_id").agg(
        F.count("*").alias("version_count"), F.bool_or(lineage).alias("has_lineage"),
        F.bool_or(F.col("status") == "quarantined").alias("version_quarantined"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return sources.join(e, "source_id", "left").join(v, "source_id", "left").select(
        "source_id", F.coalesce("evidence_count", zero).alias("evidence_count"),
        F.coalesce("version_count", zero).alias("version_count"),
        F.coalesce("has_lineage", no).alias("has_lineage"),
        (F.coalesce(F.col("ci_status") == "quarantined", no) | F.coalesce("version_quarantined", no)).alias("is_quarantined"))


def lineage_closure(versions: DataFrame) -> DataFrame:
    """Versions that replaced something or are dead, and everything they replaced.

    Every version with a predecessor is in the set already, so the transitive closure
    is one step: no recursion over long histories.
    """
    base = F.col("supersedes_id").isNotNull() | F.col("status").isin("superseded", "retracted")
    replaced = versions.where("supersedes_id IS NOT NULL").select("claim_key", F.col("supersedes_id").alias("version_id"), F.lit(True).alias("replaced")).distinct()
    return versions.join(replaced, KEY, "left").where(base | F.col("replaced")).drop("replaced")


def lineage_pairs(versions: DataFrame) -> DataFrame:
    """Each replacing or dead version beside its predecessor."""
    p = versions.select("claim_key", F.col("version_id").alias("supersedes_id"),
                        F.col("object_value").alias("predecessor_object"), F.col("status").alias("predecessor_status"))
    relation = (
        F.when(F.col("supersedes_id").isNotNull(), "supersedes")
        .when(F.col("status") == "superseded", "superseded predecessor")
        .otherwise("retracted predecessor"))
    return (
        versions.where(F.col("supersedes_id").isNotNull() | F.col("status").isin("superseded", "retracted"))
        .withColumn("relation", relation)
        .join(p, ["claim_key", "supersedes_id"], "left")
        .select(*KEY, "relation", "object_value", "status", "supersedes_id", "predecessor_object", "predecessor_status")
    )


# -- selections --------------------------------------------------------------

def search_versions(detail: DataFrame, query: str, *, branch_id: int | None = None, include_inactive: bool = False,
                    limit: int | None = None) -> DataFrame:
    """Case-insensitive substring search over subject, predicate and object, newest first."""
    needle = F.lit(query.lower())
    fields = ("subject", "predicate", "object_value", "normalized_object")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), needle), F.lit(False))
    rows = detail.where(hit)
    if branch_id is not None:
        rows = rows.where(F.col("branch_id") == branch_id)
    if not include_inactive:
        rows = rows.where(is_current())
    rows = rows.orderBy(F.col("version_id").desc(), "claim_key")
    return rows.limit(limit) if limit is not None else rows


def latest_commit(commits: DataFrame) -> DataFrame:
    """Commits with the commit before them on the same branch (the newest one is the next parent)."""
    return with_previous(commits, ["branch_id"], ["seq"], F.col("seq"), "parent_seq")


def belief_timeline(versions: DataFrame) -> DataFrame:
    """All versions of each key with their place in its history."""
    return numbered(versions, ["claim_key"], ["version_id"])


def history_by_valid_time(versions: DataFrame) -> DataFrame:
    """Non-retracted objects of each key by (valid_from, id), open starts first, all branches."""
    rows = versions.where("status <> 'retracted'").select(
        *KEY, "object_value", "valid_from", F.coalesce("valid_from", F.to_date(F.lit("0001-01-01"))).alias("sort_from"))
    return numbered(rows, ["claim_key"], ["sort_from", "version_id"]).drop("sort_from")


def choose_current(visible: DataFrame, trust_aware: bool = True) -> DataFrame:
    """Best visible version per (viewer, key) by (valid_from, score, id); without the score when trust-blind."""
    rank = ["valid_from", "score_units", "version_id"] if trust_aware else ["valid_from", "version_id"]
    best = F.max(F.struct(*rank, "object_value", "status", "source_id", "branch_id")).alias("b")
    return visible.groupBy("viewer_id", "claim_key").agg(best).select(
        "viewer_id", "claim_key", "b.version_id", "b.object_value", "b.status", "b.source_id", "b.branch_id")


def _ancestral_support(chosen: DataFrame, links: DataFrame, branches: DataFrame) -> DataFrame:
    """Active support edges of the chosen versions whose commit branch the viewer descends from."""
    live = links.where("status = 'active' AND relation = 'support'").select(
        *KEY, F.col("source_id").alias("support_source_id"), "commit_branch_id", "link_pos")
    viewers = chosen.select(F.col("viewer_id").alias("branch_id")).distinct()
    up = sized_broadcast(branch_ancestry(branches, viewers).select(F.col("branch_id").alias("viewer_id"), F.col("ancestor_id").alias("commit_branch_id")))
    return chosen.select("viewer_id", *KEY).join(live, KEY).join(up, ["viewer_id", "commit_branch_id"])


def exact_provenance(chosen: DataFrame, links: DataFrame, sources: DataFrame, branches: DataFrame) -> DataFrame:
    """Governing source per chosen version: own branch first, then trust, then the latest edge."""
    trust = sources.select(F.col("source_id").alias("support_source_id"), "trust_score", "source_ref")
    scored = _ancestral_support(chosen, links, branches).join(trust, "support_source_id", "left")
    same = (F.col("commit_branch_id") == F.col("viewer_id")).cast("int")
    best = scored.groupBy("viewer_id", *KEY).agg(F.max(F.struct(
        same.alias("own"), F.coalesce("trust_score", F.lit(0).cast("decimal(6,4)")).alias("t"), "link_pos", "support_source_id", "source_ref")).alias("b"))
    own = sources.select("source_id", F.col("source_ref").alias("own_ref"))
    return (
        chosen.join(best, ["viewer_id", *KEY], "left").join(own, "source_id", "left")
        .select("viewer_id", *KEY,
                F.coalesce("b.support_source_id", "source_id").alias("provenance_source_id"),
                F.when(F.col("b").isNull(), F.col("own_ref")).otherwise(F.col("b.source_ref")).alias("source_ref"))
    )


def support_set(chosen: DataFrame, links: DataFrame, sources: DataFrame, branches: DataFrame) -> DataFrame:
    """Distinct references behind each chosen version, one row each; its own source if it has no edge."""
    refs = sources.select(F.col("source_id").alias("support_source_id"), "source_ref")
    backed = _ancestral_support(chosen, links, branches)
    bare = chosen.join(backed.select("viewer_id", *KEY).distinct(), ["viewer_id", *KEY], "left_anti").select(
        "viewer_id", *KEY, F.col("source_id").alias("support_source_id"))
    return (
        backed.select(bare.columns).unionByName(bare).join(refs, "support_source_id")
        .where("source_ref IS NOT NULL").select("viewer_id", *KEY, "source_ref").distinct()
    )


def conflict_groups(versions: DataFrame) -> DataFrame:
    """Per key: its conflict group and whether more than one object is current in it."""
    current = is_current() & F.col("conflict_group").isNotNull()
    return versions.groupBy("claim_key").agg(
        F.max("conflict_group").alias("conflict_group"), F.count("*").alias("version_count"),
        F.count_distinct(F.when(current, F.col("normalized_object"))).alias("open_objects"),
    ).withColumn("unresolved", F.col("open_objects") > 1)


def backfill_links(versions: DataFrame) -> DataFrame:
    """Support edges for versions recorded before edges existed."""
    return versions.select(
        *KEY, "source_id", F.lit("support").alias("relation"),
        F.when(F.col("status") == "retracted", "removed").otherwise("active").alias("status"), "commit_seq")


def context_union(retrieved: DataFrame, current: DataFrame, limit: int | None = None) -> DataFrame:
    """Per question: retrieved versions, then current ones, first occurrence kept, first ``limit``.

    Inputs carry (question_id, place, claim_key, version_id); each side is already a top-k list.
    """
    both = retrieved.withColumn("part", F.lit(0)).unionByName(current.withColumn("part", F.lit(1)))
    first = both.groupBy("question_id", *KEY).agg(F.min(F.struct("part", "place")).alias("at"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("at", *KEY))
    placed = first.withColumn("position", place).drop("at")
    return placed if limit is None else placed.where(F.col("position") <= limit)


def memory_snapshot(versions: DataFrame, commits: DataFrame, branches: DataFrame, beliefs: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Exact counts of the whole store as (item, n): tables, current and conflicting versions, versions and staged writes by status."""
    v = versions.agg(
        F.count("*").alias("versions"), F.count(F.when(is_current(), 1)).alias("active_versions"),
        F.count(F.when(is_current() & F.col("conflict_group").isNotNull(), 1)).alias("conflict_versions"))
    out = v.unpivot([], ["versions", "active_versions", "conflict_versions"], "item", "n")
    for name, df in (("commits", commits), ("branches", branches), ("beliefs", beliefs)):
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n"))
    for name, df in (("versions", versions), ("staged", staged)):
        if df is not None:
            out = out.unionByName(df.groupBy(F.concat(F.lit(f"{name}:"), "status").alias("item")).agg(F.count("*").alias("n")))
    return out


def newest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of a table, the latest first."""
    return rows.orderBy(F.col(order).desc()).limit(n)


# -- log tables ----------------------------------------------------------------

def belief_identity(claims: DataFrame) -> DataFrame:
    """First-seen spelling of subject and predicate per key."""
    return claims.groupBy("claim_key").agg(F.min(F.struct("seq", "ord", "subject", "predicate")).alias("f")).select(
        "claim_key", F.col("f.seq").alias("first_seq"), F.trim("f.subject").alias("subject"), F.trim("f.predicate").alias("predicate"))


def commit_log(claims: DataFrame, control: DataFrame | None = None) -> DataFrame:
    """One commit per seq, with its operation and its parent on the same branch."""
    commits = claims.select("seq", "branch_id", F.lit("update").alias("operation")).distinct()
    if control is not None:
        commits = commits.unionByName(control.select("seq", "branch_id", F.col("op").alias("operation")))
    return latest_commit(commits)


AUDIT = "seq long, event_type string, entity_type string, entity_id long, entity_key string, n long"
# Audit events of the review steps, by the action or status that leads to them.
REVIEW_EVENTS = {
    "staged": "staged_commit.created",
    "checks_started": "memory_ci.started",
    "checks_completed": "memory_ci.completed",
    "quarantined": "staged_commit.quarantined",
    "review_required": "staged_commit.review_required",
    "released": "staged_commit.quarantine_released",
    "override_approved": "staged_commit.quarantine_override_approved",
    "approval_recorded": "staged_commit.approval_recorded",
    "approved": "staged_commit.approved",
    "rejected": "staged_commit.rejected",
}


def audit_log(events: DataFrame, commits: DataFrame, beliefs: DataFrame, *, sources: DataFrame | None = None, branches: DataFrame | None = None,
              control: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """Audit rows of every change: ``seq, event_type, entity_type, entity_id, entity_key, n``.

    From the fold's events (``n`` edges where a version took over the supporters of one it opposes, else 1), the log of commits,
    first-seen beliefs, and where given: sources (``seq, source_id``), branches (``created_seq, id, name``), control operations,
    and review steps (``seq, staged_id, step``; ``REVIEW_EVENTS``).
    """
    kind = (
        F.when(F.col("kind") == "version", "belief_version.created")
        .when(F.col("kind").isin("edge", "inherit"), F.concat(F.lit("belief_source."), "relation", F.lit("_added")))
        .when((F.col("kind") == "status") & (F.col("reason") == "retracted"), "belief_version.retracted"))
    parts = [events.withColumn("event_type", kind).where("event_type IS NOT NULL").select(
        F.shiftright("pos", 20).alias("seq"), "event_type", F.lit("belief_version").alias("entity_type"), F.col("version_id").alias("entity_id"),
        F.col("claim_key").alias("entity_key"), F.when(F.col("kind") == "inherit", F.col("n")).otherwise(1).cast("long").alias("n"))]

    def add(rows: DataFrame, seq: str, event_type, entity_type: str, entity_id, entity_key=None) -> None:
        event_type = F.lit(event_type) if isinstance(event_type, str) else event_type
        key = F.lit(None) if entity_key is None else F.col(entity_key)
        ident = F.lit(None) if entity_id is None else F.col(entity_id)
        parts.append(rows.select(F.col(seq).cast("long").alias("seq"), event_type.alias("event_type"), F.lit(entity_type).alias("entity_type"),
                                 ident.cast("long").alias("entity_id"), key.cast("string").alias("entity_key"), F.lit(1).cast("long").alias("n")))

    add(commits, "seq", "commit.created", "commit", "seq")
    add(beliefs, "first_seq", "belief.created", "belief", None, "claim_key")
    if sources is not None:
        add(sources, "seq", "source.created", "source", "source_id")
    if branches is not None:
        add(branches, "created_seq", "branch.created", "branch", "id", "name")
    if control is not None:
        add(control.where("op = 'rollback'"), "seq", "commit.rolled_back", "commit", "target")
        add(control.where("op = 'merge'"), "seq", "branch.merged", "branch", "target")
    if reviews is not None:
        event = F.coalesce(*[F.when(F.col("step") == step, name) for step, name in REVIEW_EVENTS.items()])
        add(reviews.where(F.col("step").isin(*REVIEW_EVENTS)), "seq", event, "staged_commit", "staged_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_filter(audit: DataFrame, limit: int | None = None, *, entity_type: str | None = None, entity_id: int | None = None,
                 entity_key: str | None = None) -> DataFrame:
    """Newest audit rows, optionally for one kind, id or key."""
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id), ("entity_key", entity_key)):
        if value is not None:
            audit = audit.where(F.col(name) == value)
    rows = audit.orderBy(F.col("seq").desc(), "event_type", "entity_id", "entity_key")
    return rows if limit is None else rows.limit(limit)


def commit_history(commits: DataFrame, versions: DataFrame | None = None, *, seq: int | None = None,
                   branch_id: int | None = None, claim_key: str | None = None) -> DataFrame:
    """Commits by id, by branch, or by the key they introduced versions of; newest first."""
    if seq is not None:
        return commits.where(F.col("seq") == seq)
    if branch_id is not None:
        commits = commits.where(F.col("branch_id") == branch_id)
    if claim_key is not None:
        touched = versions.where(F.col("claim_key") == claim_key).select(F.col("commit_seq").alias("seq"))
        commits = commits.join(touched, "seq", "left_semi")
    return commits.orderBy(F.col("seq").desc())
