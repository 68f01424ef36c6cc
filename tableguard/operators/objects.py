"""Two-pass classification of catalog objects by rules, columns, samples and neighbours.

Rules are configuration, so matching an object against them is a narrow projection and not a
join. Everything that gathers evidence for an object is a grouped aggregate that only keeps what
the rules can use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.operators.spread import own_copy, own_if_null, salted
from tableguard.sources.rules import Rule, Rules

# Confidences, limits and evidence kinds.
EXACT, PREFIX, SCHEMA, COMMENT, NEIGHBOUR, SHAPE = 1.0, 0.98, 0.95, 0.72, 0.80, 0.68
MARGIN, SIMILAR = 0.15, 0.25
ROUTINE_EDGES = ("routine_read", "routine_write", "routine_call")
CONFIRMED, SUGGESTED, UNRESOLVED = "final_confirmed", "final_suggested", "final_unresolved"
MATCH = "category string, confidence double, kind string, summary string, authoritative boolean"


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _match(category: str, confidence: Column | float, kind: str, summary: Column | str, sure: bool) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    s = summary if isinstance(summary, Column) else F.lit(summary)
    return F.struct(
        F.lit(category).alias("category"),
        c.cast("double").alias("confidence"),
        F.lit(kind).alias("kind"),
        s.alias("summary"),
        F.lit(sure).alias("authoritative"),
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _name_match(rule: Rule, with_comment: bool) -> Column:
    name, schema = F.upper("object_name"), F.lower("schema_name")
    exact = name.isin([n.upper() for n in rule.exact_names]) if rule.exact_names else F.lit(False)
    prefix = _any([name.startswith(p.upper()) for p in rule.prefixes])
    in_schema = schema.isin([s.lower() for s in rule.schemas]) if rule.schemas else F.lit(False)
    out = (
        F.when(exact, _match(rule.name, EXACT, "configured_exact", F.concat(F.lit("exact name "), name), True))
        .when(prefix, _match(rule.name, PREFIX, "configured_prefix", F.concat(F.lit("configured prefix for "), name), True))
        .when(in_schema, _match(rule.name, SCHEMA, "configured_schema", F.concat(F.lit("configured schema "), schema), True))
    )
    if with_comment and rule.comment_keywords:
        comment = F.lower(F.coalesce(F.col("native_comment"), F.lit("")))
        said = _any([comment.contains(k.lower()) for k in rule.comment_keywords])
        out = out.when(said, _match(rule.name, COMMENT, "comment", "sanitized native comment", False))
    return out


def rule_matches(rules: Rules, with_comment: bool = True) -> Column:
    """Array of the first-pass matches of an object, at most one per rule."""
    each = [_name_match(r, with_comment) for r in rules.categories]
    return F.array_compact(F.array(*each)).cast(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>")


def _rows(df: DataFrame, matches: Column, seq: int) -> DataFrame:
    return df.select("object_id", F.inline(matches)).withColumn("seq", F.lit(seq))


def pass1_matches(objects: DataFrame, rules: Rules) -> DataFrame:
    """One row per (object, matching rule): exact name, prefix, schema or comment keyword."""
    return _rows(objects, rule_matches(rules), 1)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of two or more letters or digits."""
    words = F.split(F.lower(text), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def _words(*texts: str) -> list[str]:
    import re

    found = {w for t in texts for w in re.split(r"[^a-z0-9]+", t.lower()) if len(w) > 1}
    return sorted(found)


def column_overlap(columns: DataFrame, rules: Rules) -> DataFrame:
    """Matches from column names: 0.65 plus 0.05 per keyword shared with a rule, 0.88 at most.

    Only words that some rule uses survive the first projection, so a group never holds more
    than the keywords of one rule.
    """
    keyed = [(r, _words(*r.column_keywords)) for r in rules.categories if r.column_keywords]
    if not keyed:
        return _none(columns)
    known = sorted({w for _, words in keyed for w in words})
    useful = F.array_intersect(word_set(F.col("column_name")), _texts(known))
    words = columns.select("object_id", F.explode(useful).alias("word"))
    hits = [F.when(F.col("word").isin(w), F.lit(r.name)) for r, w in keyed]
    rows = words.select("object_id", "word", F.explode(F.array_compact(F.array(*hits))).alias("category"))
    shared = rows.groupBy("object_id", "category").agg(F.array_sort(F.collect_set("word")).alias("words"))
    confidence = F.least(F.lit(0.88), F.lit(0.65) + F.lit(0.05) * F.size("words"))
    return shared.select(
        "object_id",
        "category",
        confidence.alias("confidence"),
        F.lit("columns").alias("kind"),
        F.concat(F.lit("column shape: "), F.array_join("words", ", ")).alias("summary"),
        F.lit(False).alias("authoritative"),
        F.lit(2).alias("seq"),
    )


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"object_id string, {MATCH}, seq int")


def name_similarity(objects: DataFrame, rules: Rules) -> DataFrame:
    """Matches from the words an object name shares with a rule's name and description."""
    own = word_set(F.col("object_name"))
    out = []
    for r in rules.categories:
        theirs = _texts(_words(r.name, r.description))
        shared = F.size(F.array_intersect(own, theirs)).cast("double")
        similarity = shared / F.greatest(F.lit(1), F.size(F.array_union(own, theirs)))
        confidence = F.least(F.lit(0.70), F.lit(0.50) + similarity / 2)
        out.append(
            F.when(
                similarity >= SIMILAR,
                _match(r.name, confidence, "token_similarity", "name token similarity", False),
            )
        )
    return _rows(objects, F.array_compact(F.array(*out)), 3)


def neighbour_vote(edges: DataFrame, pass1: DataFrame) -> DataFrame:
    """Match when all neighbours with a first-pass category agree on it.

    ``edges`` has ``source_object_id, target_object_id, edge_type``; ``pass1`` has
    ``object_id, category``. An edge is shuffled with both its ends twice: to copies of the target's
    category, where parallel edges are merged, and to copies of the source's. It then brings each
    end the category of the other. The copies spread the edges of a hub over several tasks, and
    agreement is a minimum and a maximum, so a hub costs no more memory than any other object. The
    first grouping only hashes; the second, which sorts for the minimum of texts, gets a row per
    object and category.
    """
    known = pass1.where(F.col("category").isNotNull()).select("object_id", "category")

    def met(rows: DataFrame, end: str, other: str) -> DataFrame:
        copies = salted(known.select(F.col("object_id").alias(end), F.col("category").alias(f"{end}_category")), long=True)
        return rows.withColumn("__tg_salt", own_copy(other)).join(copies, [end, "__tg_salt"], "left")

    routine = F.col("edge_type").isin(*ROUTINE_EDGES).alias("routine")
    rows = edges.select(F.col("source_object_id").alias("a"), F.col("target_object_id").alias("b"), routine)
    # Grouped as the join has dealt them, so nothing is shuffled between the two.
    merged = met(rows, "b", "a").groupBy("b", "__tg_salt", "a", "b_category").agg(F.bool_or("routine").alias("routine"))
    ends = [F.struct(F.col(x).alias("object_id"), F.col(f"{y}_category").alias("category")) for x, y in ("ab", "ba")]
    votes = (
        met(merged, "a", "b")
        .select(F.inline(F.array(*ends)), "routine")
        .groupBy("object_id", "category")
        .agg(F.bool_or("routine").alias("routine"))
        .groupBy("object_id")
        .agg(F.min("category").alias("low"), F.max("category").alias("high"), F.bool_or("routine").alias("routine"))
        .where(F.col("low") == F.col("high"))
    )
    return votes.select(
        "object_id",
        F.col("low").alias("category"),
        F.lit(NEIGHBOUR).alias("confidence"),
        F.when(F.col("routine"), "routine_dependency").otherwise("foreign_key_neighborhood").alias("kind"),
        F.lit("single-category dependency neighborhood").alias("summary"),
        F.lit(False).alias("authoritative"),
        F.lit(4).alias("seq"),
    )


def sample_shape(samples: DataFrame, rules: Rules) -> DataFrame:
    """Matches from the column names of a sample (``object_id, columns``) that hold a keyword."""
    names = F.lower(F.array_join("columns", " "))
    out = [
        F.when(
            _any([names.contains(k.lower()) for k in r.column_keywords]),
            _match(r.name, SHAPE, "sample_shape", "sanitized sample column shape", False),
        )
        for r in rules.categories
        if r.column_keywords
    ]
    return _rows(samples, F.array_compact(F.array(*out)), 5) if out else _none(samples)


def evidence_id(kind: Column, category: Column, summary: Column) -> Column:
    text = F.concat_ws("\0", F.col("object_id"), kind, category, summary)
    return F.concat(F.lit("ev_"), F.substring(F.sha2(text, 256), 1, 24))


def evidence(matches: DataFrame, length: int | None = 240) -> DataFrame:
    """Evidence record of every match: id, object, kind and a summary, cut to a length if there is one."""
    made = evidence_id(F.col("kind"), F.col("category"), F.col("summary"))
    summary = F.col("summary") if length is None else F.substring("summary", 1, length)
    return matches.select(made.alias("evidence_id"), "object_id", "kind", summary.alias("summary")).distinct()


def _decide(rows: DataFrame, allow_confirmed: bool) -> DataFrame:
    """Decision per object from ``found``, the array of all its matches.

    Of the matches of one category the most confident counts, of equal ones the earlier kind of
    evidence. All of it is array work inside one row.
    """
    by_category = F.array_sort(
        F.transform(
            "found",
            lambda m: F.struct(m["category"].alias("category"), (-m["confidence"]).alias("rank"), m["seq"].alias("seq"), m.alias("match")),
        )
    )
    rows = rows.withColumn("sorted", by_category)
    first_of = F.filter(
        "sorted",
        lambda m, i: (i == 0) | (F.get("sorted", i - 1)["category"] != m["category"]),
    )
    ranked = F.array_sort(
        F.transform(
            first_of,
            lambda m: F.struct(m["rank"].alias("rank"), m["category"].alias("category"), m["match"].alias("match")),
        )
    )
    rows = rows.withColumn("ranked", F.transform(ranked, lambda m: m["match"]))
    sure = F.filter("ranked", lambda m: m["authoritative"])
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    close = (F.size("ranked") > 1) & (first["confidence"] - second["confidence"] < MARGIN)
    authoritative = F.lit(allow_confirmed) & (F.size(sure) > 0)
    one = F.size(sure) == 1
    status = (
        F.when(F.size("ranked") == 0, UNRESOLVED)
        .when(authoritative, F.when(one, CONFIRMED).otherwise(UNRESOLVED))
        .when(close, UNRESOLVED)
        .otherwise(SUGGESTED)
    )
    category = F.when(authoritative, F.when(one, F.get(sure, F.lit(0))["category"])).when(
        ~close, first["category"]
    )
    candidates = F.transform(
        "ranked",
        lambda m: F.struct(
            m["category"].alias("category"),
            m["confidence"].alias("confidence"),
            m["kind"].alias("kind"),
            evidence_id(m["kind"], m["category"], m["summary"]).alias("evidence_id"),
        ),
    )
    return rows.select(
        "object_id", category.alias("category"), status.alias("status"), candidates.alias("candidates")
    )


def pick(matches: DataFrame, allow_confirmed: bool, objects: DataFrame | None = None) -> DataFrame:
    """(object_id, category, status, candidates) from the matches of each object.

    A single authoritative category confirms, two leave the object unresolved; otherwise the two
    best candidates must differ by at least 0.15. With ``objects``, every object and no other gets
    a row. One shuffle in all; the matches of an object are bounded by the rules and the kinds of
    evidence.
    """
    match = F.struct("category", "confidence", "kind", "summary", "authoritative", "seq")
    rows = matches.select("object_id", match.alias("m"), F.lit(False).alias("listed"))
    if objects is not None:
        empty = objects.select("object_id", F.lit(None).cast(rows.schema["m"].dataType).alias("m"), F.lit(True).alias("listed"))
        rows = rows.unionByName(empty)
    grouped = rows.groupBy("object_id").agg(F.collect_list("m").alias("found"), F.bool_or("listed").alias("listed"))
    return _decide(grouped if objects is None else grouped.where("listed"), allow_confirmed)


def pass1(objects: DataFrame, rules: Rules) -> DataFrame:
    """First pass: preliminary category per object. A projection; nothing is shuffled."""
    found = F.transform(rule_matches(rules), lambda m: m.withField("seq", F.lit(1)))
    return _decide(objects.select("object_id", found.alias("found")), allow_confirmed=False).withColumn(
        "status", F.lit("preliminary")
    )


def apply_overrides(final: DataFrame, overrides: DataFrame) -> DataFrame:
    """Owner overrides (``object_id, override``) win and confirm."""
    joined = final.join(overrides, "object_id", "left")
    return joined.withColumn("category", F.coalesce("override", "category")).withColumn(
        "status", F.when(F.col("override").isNotNull(), CONFIRMED).otherwise(F.col("status"))
    ).drop("override")


def _override_rows(spark, rules: Rules) -> DataFrame:
    return spark.createDataFrame(list(rules.overrides.items()), "object_id string, override string")


def all_matches(
    objects: DataFrame,
    first: DataFrame,
    rules: Rules,
    columns: DataFrame | None = None,
    edges: DataFrame | None = None,
    samples: DataFrame | None = None,
    proposals: DataFrame | None = None,
) -> DataFrame:
    """Every match of the second pass, first-pass matches included."""
    out = pass1_matches(objects, rules).unionByName(name_similarity(objects, rules))
    if columns is not None:
        out = out.unionByName(column_overlap(columns, rules))
    if edges is not None:
        out = out.unionByName(neighbour_vote(edges, first))
    if samples is not None:
        out = out.unionByName(sample_shape(samples, rules))
    if rules.overrides:
        forced = _override_rows(objects.sparkSession, rules).select(
            "object_id",
            F.col("override").alias("category"),
            F.lit(1.0).alias("confidence"),
            F.lit("owner_override").alias("kind"),
            F.lit("owner-approved persistent override").alias("summary"),
            F.lit(True).alias("authoritative"),
            F.lit(0).alias("seq"),
        )
        # The overrides are broadcast, never the objects.
        out = out.unionByName(objects.select("object_id").join(F.broadcast(forced), "object_id").distinct())
    if proposals is not None:
        # However many proposals repeat a category, the most confident one is kept per object.
        best = proposals.groupBy("object_id", "category").agg(
            F.max(F.struct(F.col("confidence").cast("double").alias("confidence"), F.col("origin"))).alias("p")
        )
        out = out.unionByName(
            best.select(
                "object_id",
                "category",
                F.col("p.confidence").alias("confidence"),
                F.lit("model_proposal").alias("kind"),
                F.concat(F.lit("sanitized proposal from "), F.col("p.origin")).alias("summary"),
                F.lit(False).alias("authoritative"),
                F.lit(6).alias("seq"),
            )
        )
    return out


def pass2(
    objects: DataFrame,
    first: DataFrame,
    rules: Rules,
    columns: DataFrame | None = None,
    edges: DataFrame | None = None,
    samples: DataFrame | None = None,
    proposals: DataFrame | None = None,
) -> DataFrame:
    """Second pass: final category, status and candidates per object."""
    matches = all_matches(objects, first, rules, columns, edges, samples, proposals)
    final = pick(matches, True, objects)
    if rules.overrides:
        final = apply_overrides(final, _override_rows(objects.sparkSession, rules))
    return final


def intake(
    proposals: DataFrame, objects: DataFrame, known_evidence: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Proposals with ``accepted``: the object and category are known and every evidence id
    belongs to the object. ``proposals`` has ``proposal_id, object_id, category, evidence_ids``."""
    cited = proposals.select("proposal_id", "object_id", F.explode("evidence_ids").alias("evidence_id"))
    owned = known_evidence.select("evidence_id", "object_id").distinct()
    wrong = cited.join(owned, ["evidence_id", "object_id"], "left_anti").select("proposal_id").distinct()
    known = objects.select("object_id").distinct().withColumn("known", F.lit(True))
    marked = proposals.join(known, "object_id", "left").join(
        wrong.withColumn("wrong", F.lit(True)), "proposal_id", "left"
    )
    ok = F.col("known").isNotNull() & F.col("category").isin(*categories) & F.col("wrong").isNull()
    return marked.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("known", "wrong")


def intake_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count_if("accepted").alias("accepted_as_suggestion"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if("accepted").alias("requires_owner_resolution"),
    )


def changes(first: DataFrame, final: DataFrame, selected: Sequence[str] = ()) -> DataFrame:
    """Category before and after, and moves into or out of the selected categories.

    Both sides are as long as the catalog, however small its file: neither is broadcast.
    """
    a = first.select("object_id", F.col("category").alias("pass_1_category"))
    b = final.select("object_id", F.col("category").alias("pass_2_category"))

    def inside(c: str) -> Column:
        return F.coalesce(F.col(c).isin(*selected), F.lit(False)) if selected else F.lit(False)

    was, now = inside("pass_1_category"), inside("pass_2_category")
    some = F.lit(bool(selected))
    return a.hint("shuffle_hash").join(b, "object_id").select(
        "object_id",
        "pass_1_category",
        "pass_2_category",
        (some & ~was & now).alias("moved_into_selected"),
        (some & was & ~now).alias("moved_out_of_selected"),
    )


def open_requests(final: DataFrame, known_evidence: DataFrame) -> DataFrame:
    """Objects that still need the owner, with the summaries behind their candidates.

    The joins are on keys that are never null: nullable ones would put a filter under one side only,
    and what ``final`` and ``known_evidence`` have in common would be shuffled once for each.
    """
    todo = final.where(F.col("status") != CONFIRMED)
    request = F.concat(F.lit("clr_"), F.substring(F.sha2("object_id", 256), 1, 20))

    def key(name: str, side: str) -> Column:
        own = F.concat(F.lit(f"\0{side}"), F.xxhash64("object_id", "evidence_id").cast("string"))
        return F.coalesce(F.col(name), own).alias(f"__tg_{name}")

    cited = todo.select("object_id", F.posexplode("candidates").alias("at", "c")).select(
        "object_id", "at", F.col("c.evidence_id").alias("evidence_id")
    )
    keys = ["object_id", "evidence_id"]
    text = known_evidence.select(*[key(k, "known") for k in keys], "summary")
    gathered = (
        cited.select(*[key(k, "cited") for k in keys], "at")
        .hint("shuffle_hash")
        .join(text, [f"__tg_{k}" for k in keys])
        .groupBy("__tg_object_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "summary"))).alias("e"))
        .select("__tg_object_id", F.transform("e", lambda x: x["summary"]).alias("sanitized_evidence"))
    )
    none = F.array().cast("array<string>")
    keyed = todo.withColumn("__tg_object_id", own_if_null(F.col("object_id"), "candidates"))
    return keyed.join(gathered, "__tg_object_id", "left").select(
        request.alias("request_id"),
        "object_id",
        F.coalesce("sanitized_evidence", none).alias("sanitized_evidence"),
        F.transform("candidates", lambda c: c["category"]).alias("candidate_categories"),
    )


def source_and_tags(final: DataFrame, objects: DataFrame) -> DataFrame:
    """Where a classification comes from (owner, rule, unknown) and the tags it exports.

    Both sides are as long as the catalog, however small its file: neither is broadcast.
    """
    rows = final.join(objects.select("object_id", "object_type").hint("shuffle_hash"), "object_id")
    sure = F.col("status") == CONFIRMED
    owner = F.exists("candidates", lambda c: c["kind"] == "owner_override")
    category = F.when(sure, F.col("category"))
    tags = F.when(category.isNotNull(), F.array_sort(F.array_distinct(F.array(category, "object_type"))))
    return rows.select(
        "object_id",
        category.alias("context"),
        F.when(sure & owner, "owner").when(sure, "rule").otherwise("unknown").alias("classification_source"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )


def classify_corpus(headers: DataFrame, rules: Rules) -> DataFrame:
    """Rule classification of file headers: exactly one matching rule confirms, any other number
    only leaves evidence. Confirmed headers are kept as they are."""
    described = {r.name: r.description for r in rules.categories}
    found = rule_matches(rules, with_comment=False)
    staged = headers.select("*", found.alias("__tg_m"))
    listed = F.array_sort(
        F.transform("__tg_m", lambda m: F.concat(F.lit("rule:"), m["kind"], F.lit(":"), m["category"]))
    )
    todo = F.col("classification_status") != "confirmed"
    one = todo & (F.size("__tg_m") == 1)
    category = F.get("__tg_m", F.lit(0))["category"]
    description = None
    for name, text in described.items():
        test = category == name
        value = F.lit(text or None).cast("string")
        description = F.when(test, value) if description is None else description.when(test, value)
    new = {
        "context": F.when(one, category).otherwise(F.col("context")),
        "description": F.when(one, description).otherwise(F.col("description")),
        "tags": F.when(one, F.array().cast("array<string>")).otherwise(F.col("tags")),
        "evidence": F.when(todo, listed).otherwise(F.col("evidence")),
        "classification_status": F.when(one, "confirmed").otherwise(F.col("classification_status")),
        "classification_source": F.when(one, "rule").otherwise(F.col("classification_source")),
    }
    return staged.select(*[new[c].alias(c) if c in new else F.col(c) for c in headers.columns])
