"""Ranked, stratified, capped and batched selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.identity import seeded, sha, stable_rank
from textloom.operators import dedup as D
from textloom.operators import sampler as P
from textloom.operators import select as O
from textloom.plans import similarity as M
from textloom.plans import sqltext as S
from textloom.session import load, write_table

SEED = "route-sample-v1"


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"])


def _candidates(spark, sf_dir):
    return load(spark, sf_dir, "text_candidates").dropDuplicates(["candidate_id"])


def route_sample(spark, sf_dir):
    """Ten answers of every route by seeded rank."""
    rows = _answers(spark, sf_dir).select("id", "route").withColumn("digest", seeded(SEED, F.col("route"), F.col("id")))
    return O.top_per_group(rows, ["route"], ["digest", "id"], 10)


def first_per_route(spark, sf_dir):
    """The first five answers of every route by id."""
    return O.top_per_group(_answers(spark, sf_dir).select("id", "route"), ["route"], ["id"], 5)


def language_top(spark, sf_dir):
    """The twenty least ranked accepted candidates of every language and domain."""
    rows = _candidates(spark, sf_dir).where("accepted").select("candidate_id", "language_tag", "domain", "selection_rank")
    return O.top_per_group(rows, ["language_tag", "domain"], ["selection_rank", "candidate_id"], 20)


def bottom_candidates(spark, sf_dir):
    """The hundred candidates of least rank."""
    rows = _candidates(spark, sf_dir).select("candidate_id", stable_rank("source_id", "source_record_id").alias("digest"))
    return O.bottom_k(rows.where("digest is not null"), ["digest", "candidate_id"], 100)


def sample_with_long_quota(spark, sf_dir):
    """Evaluation lines of every language: 20 distinct texts of least rank, and 5 more of at least 300 characters."""
    docs = load(spark, sf_dir, "documents").where("text is not null and text <> '' and lang is not null").select("lang", "doc_id", F.length("text").alias("characters"), F.sha2("text", 256).alias("content"))
    once = O.top_per_group(docs, ["lang", "content"], ["doc_id"], 1).drop("rank").withColumn("digest", seeded(7, F.col("lang"), F.col("content")))
    plain = O.top_per_group(once, ["lang"], ["digest", "doc_id"], 20).withColumn("quota", F.lit("plain"))
    rest = once.where("characters >= 300").join(plain.select("doc_id"), "doc_id", "left_anti")
    long = O.top_per_group(rest, ["lang"], ["digest", "doc_id"], 5).withColumn("quota", F.lit("long"))
    return plain.unionByName(long).select("lang", "quota", "rank", "doc_id", "characters")


def stratified_interleave(spark, sf_dir):
    """Review order over sources and routes: one of each stratum in turn."""
    rows = _answers(spark, sf_dir).select("id", F.concat_ws("|", "source_id", "route").alias("stratum"))
    turns = O.interleave(rows, "stratum", sha(F.col("id")), sha(F.col("stratum")), 200)
    ordered = turns.select("id", "stratum", "turn", "stratum_rank")
    return O.bottom_k(ordered, ["turn", "stratum_rank", "id"], 200)


def round_robin_batches(spark, sf_dir):
    """Documents of the five languages by turns, in batches of 64, by batch and language."""
    tags = ["eng_Latn", "zho_Hans", "zho_Hant", "jpn_Jpan", "kor_Hang"]
    docs = load(spark, sf_dir, "documents").where(F.col("lang").isin(*tags)).select("doc_id", "lang")
    turn = O.ranked(docs, "lang", ["doc_id"], "turn")
    # A document's place is the number of documents of all languages in earlier turns, and of earlier languages in its own.
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # five rows at most
    own = F.array_position(F.array(*map(F.lit, tags)), F.col("lang"))
    place = F.lit(0).cast("bigint")
    for position, tag in enumerate(tags, 1):
        place = place + F.least(F.lit(sizes.get(tag, 0)), F.col("turn") + F.when(F.lit(position) < own, 1).otherwise(0))
    placed = turn.withColumn("place", place)
    return placed.groupBy(F.floor(F.col("place") / 64).cast("int").alias("batch"), "lang").agg(F.count("*").alias("documents"), F.min("place").alias("first_place"))


def review_extremes(spark, sf_dir):
    """Of every route the shortest, the longest and the most uneven accepted answer, then eight more by rank."""
    rows = _answers(spark, sf_dir).where("challenger_filter_accepted and challenger_translation is not null")
    rows = rows.select("id", "route", F.length("challenger_translation").alias("n"), X.length_ratio(F.col("source_text"), F.col("challenger_translation")).alias("r"))
    picks = rows.groupBy("route").agg(
        F.min_by("id", F.struct("n", "id")).alias("shortest"), F.min_by("id", F.struct(-F.col("n"), "id")).alias("longest"), F.min_by("id", F.struct(-F.col("r"), "id")).alias("uneven")
    )
    named = F.array(*(F.struct(F.lit(k).alias("why"), F.col(k).alias("id")) for k in ("shortest", "longest", "uneven")))
    chosen = picks.select("route", F.explode(named).alias("x")).select("route", "x.id", "x.why").groupBy("route", "id").agg(F.min("why").alias("why"))
    rest = rows.join(chosen.select("id"), "id", "left_anti").withColumn("digest", sha(F.col("id")))
    fill = O.top_per_group(rest, ["route"], ["digest", "id"], 8).select("route", "id", F.lit("fill").alias("why"))
    return chosen.unionByName(fill)


def reject_per_reason(spark, sf_dir):
    """One rejected candidate of every language and reason, then the next by rank up to ten a language."""
    rows = _candidates(spark, sf_dir).where("reason is not null").select("candidate_id", "language_tag", "reason", sha(F.col("candidate_id").cast("string")).alias("digest"))
    firsts = rows.groupBy("language_tag", "reason").agg(F.min_by("candidate_id", F.struct("digest", "candidate_id")).alias("candidate_id")).select("candidate_id", F.lit(True).alias("first"))
    rows = rows.join(firsts, "candidate_id", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    return O.top_per_group(rows, ["language_tag"], [F.col("first").desc(), F.col("digest"), F.col("candidate_id")], 10).select("language_tag", "rank", "candidate_id", "reason", "first")


def quality_queue(spark, sf_dir):
    """Of every route the first rejected answers, real rejects before others, and the first accepted ones."""
    rows = _answers(spark, sf_dir).select("id", "route", "challenger_filter_accepted", F.size(F.coalesce("challenger_rejection_reasons", F.array())).alias("reasons"))
    rows = rows.where("challenger_filter_accepted is not null").withColumn("kind", F.when(F.col("challenger_filter_accepted"), "accepted").otherwise("rejected"))
    rows = rows.withColumn("digest", stable_rank("route", "id"))
    return O.top_per_group(rows, ["route", "kind"], [F.when(F.col("reasons") > 0, 0).otherwise(1), "digest", "id"], 4).select("route", "kind", "rank", "id")


def domain_ceilings(spark, sf_dir):
    """Accepted candidates under share ceilings for two domains, by domain."""
    rows = _candidates(spark, sf_dir).where("accepted").select("candidate_id", "selection_rank", F.coalesce("domain", F.lit("unknown")).alias("domain"))
    kept = O.with_ceilings(rows, "domain", ["selection_rank", "candidate_id"], {"technical": 0.15, "legal_and_government": 0.20})
    return kept.groupBy("domain").agg(F.count("*").alias("kept"), F.max("selection_rank").alias("last_rank"))


def host_caps(spark, sf_dir):
    """Documents of a host, at most thirty, by host."""
    docs = load(spark, sf_dir, "documents").where("url is not null").select("doc_id", F.lower(F.expr("parse_url(url, 'HOST')")).alias("host"))
    kept = O.top_per_group(docs, ["host"], [sha(F.col("doc_id").cast("string")), "doc_id"], 30)
    return kept.groupBy("host").agg(F.count("*").alias("kept"), F.min("doc_id").alias("first_doc"))


def budget_fill(spark, sf_dir):
    """Documents of every language and domain that fit a budget of 20,000 characters, skipping what does not fit."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat_ws("|", F.coalesce("lang", F.lit("none")), F.coalesce("domain", F.lit("none"))).alias("slice"), F.length("text").alias("characters"))
    kept = O.greedy_fill(docs, "slice", "doc_id", "characters", 20_000)
    return kept.groupBy("slice").agg(F.count("*").alias("documents"), F.sum("characters").alias("characters"))


def token_batches(spark, sf_dir):
    """Answers of every route in batches of at most 16 rows and 1,200 tokens."""
    rows = _answers(spark, sf_dir).select("id", "route", F.coalesce("challenger_completion_tokens", F.lit(0)).alias("tokens"))
    packed = O.token_batches(rows, "route", "id", "tokens", most_rows=16, most_tokens=1200)
    return packed.groupBy("route", "batch").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def sampling_plan(spark, sf_dir):
    """Draws of every route in 1,000 by smooth weighted round robin, routes of a class sharing its weight."""
    rows = load(spark, sf_dir, "encoded_samples").select(F.col("provenance.kind").alias("kind"), F.concat_ws("->", "source_language", "target_language").alias("route")).where("kind is not null").distinct()
    names = [(r.kind, r.route) for r in rows.orderBy("kind", "route").collect()]  # at most a row a class and route
    weights = {"human_parallel": 3, "teacher_generated": 1}
    kinds = O.smooth_shares({k: weights.get(k, 1) for k in dict.fromkeys(k for k, _ in names)}, 1000)
    plan = []
    for kind, draws in kinds.items():
        for route, n in O.smooth_shares({r: 1 for k, r in names if k == kind}, draws).items():
            plan.append((kind, route, n))
    return spark.createDataFrame(plan, "kind string, route string, draws long")


def length_buckets(spark, sf_dir):
    """Sample batches of similar length, by language: rows and padding of each batch."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).where("input_ids is not null").select("sample_id", "source_language", F.size("input_ids").alias("n"))
    batched = O.length_buckets(rows.withColumn("digest", sha(F.col("sample_id"))), ["digest", "sample_id"], "n", batch=16, pool=4, group="source_language")
    return batched.groupBy("source_language", "pool", "batch").agg(F.count("*").alias("rows"), F.max("n").alias("longest"), (F.count("*") * F.max("n") - F.sum("n")).alias("padding"))


def shard_strata(spark, sf_dir):
    """One shard of every language by size, then the next, four in all."""
    rows = load(spark, sf_dir, "corpus_manifest").where("language is not null").select("language", "shard_id", F.coalesce("documents", F.lit(0)).alias("documents"))
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("language").orderBy(F.desc("documents"), "shard_id")))
    return O.bottom_k(rows, ["turn", F.desc("documents"), "language", "shard_id"], 4)


def forced_review(spark, sf_dir):
    """Regressions forced into a review of 60, the rest by rank."""
    rows = _answers(spark, sf_dir).select("id", "route", (F.coalesce("baseline_filter_accepted", F.lit(False)) & ~F.coalesce("challenger_filter_accepted", F.lit(True))).alias("forced"))
    rows = rows.withColumn("digest", stable_rank("route", "id"))
    return O.bottom_k(rows, [F.col("forced").desc(), "digest", "id"], 60).select("id", "route", "forced")


def balanced_corpus(spark, sf_dir):
    """Lines of every language in seeded order up to the characters of the language that has fewest."""
    docs = load(spark, sf_dir, "documents").where("text is not null and lang is not null").select("doc_id", "lang", F.length("text").alias("characters"))
    least = docs.groupBy("lang").agg(F.sum("characters").alias("n")).agg(F.min("n")).first()[0] or 0
    kept = O.greedy_fill(docs.withColumn("digest", seeded(SEED, F.col("doc_id").cast("string"))), "lang", "digest", "characters", least)
    return kept.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("characters").alias("characters"))


def source_bank(spark, sf_dir):
    """Candidates of every language for a bank of 40: stated tokens in bounds, unknown to the entries, first by rank."""
    rows = _candidates(spark, sf_dir).where("accepted and student_tokens between 4 and 256 and text is not null")
    rows = rows.select("candidate_id", "language_tag", D.identity(F.col("text")).alias("exact"), D.near_identity(F.col("text")).alias("near"), "selection_rank")
    entries = load(spark, sf_dir, "text_entries").where("text is not null").select(D.identity(F.col("text")).alias("exact"), D.near_identity(F.col("text")).alias("near"))
    rows = rows.join(entries.select("exact").distinct(), "exact", "left_anti").join(entries.select("near").distinct(), "near", "left_anti")
    rows = rows.groupBy("language_tag", "near").agg(F.min(F.struct("selection_rank", "candidate_id")).alias("x")).select("language_tag", "x.*")
    return O.top_per_group(rows, ["language_tag"], ["selection_rank", "candidate_id"], 40)


def role_selection(spark, sf_dir):
    """Candidates for two roles, 40 and then 120 by rank: none shares its record, its exact or its near text with one taken before, in either role."""
    rows = _candidates(spark, sf_dir).where("accepted and text is not null").select(
        "candidate_id", F.concat(F.lit("g:"), F.concat_ws("|", "source_id", "source_record_id")).alias("g"), "source_record_id",
        F.concat(F.lit("e:"), D.identity(F.col("text"))).alias("e"), F.concat(F.lit("n:"), D.near_identity(F.col("text"))).alias("n"),
    )
    rows = rows.withColumn("claims", F.array(F.when(F.col("source_record_id").isNotNull(), F.col("g")), "e", "n"))
    used, found = None, []
    for role, size in _ROLES:
        digest = F.struct(seeded(role, F.col("candidate_id").cast("string")).alias("d"), "candidate_id")
        taken = O.greedy_disjoint(rows, "candidate_id", digest, F.col("claims"), used=used)
        first = write_table(O.bottom_k(taken.withColumn("d", digest), ["d"], size), "role").frame
        found.append(first.select(F.lit(role).alias("role"), F.row_number().over(W.orderBy("d")).alias("position"), "candidate_id"))  # of the few taken
        claims = first.select(F.explode(F.array_compact("claims")).alias("claim"))
        used = claims if used is None else used.unionByName(claims)
    return found[0].unionByName(found[1])


_ROLES = (("dev", 40), ("train", 120))


def composite_audit(spark, sf_dir):
    """Union of human and teacher samples by kind: ids and content that repeat, groups both kinds use, routes covered."""
    rows = load(spark, sf_dir, "encoded_samples").select(F.col("provenance.kind").alias("kind"), "sample_id", "sample_group_id", F.concat_ws("->", "source_language", "target_language").alias("route"), sha(F.concat_ws("|", F.array_join(F.col("input_ids").cast("array<string>"), ","), F.array_join(F.col("labels").cast("array<string>"), ","))).alias("content"))
    shared = rows.where("sample_group_id is not null and kind is not null").groupBy("sample_group_id").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1").select("sample_group_id", F.lit(True).alias("shared"))
    return rows.join(shared, "sample_group_id", "left").groupBy("kind").agg(
        F.count("*").alias("rows"), F.count_distinct("sample_id").alias("ids"), F.count_distinct("content").alias("contents"), F.count_distinct("route").alias("routes"), F.count_if("shared").alias("in_shared_groups")
    )


def epoch_schedule(spark, sf_dir):
    """The first 400 draws of a sampler that takes routes in turn and, inside a route, its samples epoch after epoch in an order of their own."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).select("sample_id", F.concat_ws("->", "source_language", "target_language").alias("route"))
    routes = [r.route for r in rows.select("route").distinct().orderBy("route").collect()]  # at most twenty
    sizes = rows.groupBy("route").agg(F.count("*").alias("n"))
    turn = F.array_position(F.array(*map(F.lit, routes)), F.col("route")) - 1
    need = F.ceil((F.lit(400) - turn) / len(routes)).cast("bigint")
    epochs = rows.join(sizes, "route").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(need, F.lit(1)) - 1) / F.col("n")))))
    epochs = epochs.withColumn("digest", seeded(SEED, F.col("epoch").cast("string"), F.col("sample_id")))
    ordered = O.top_per_group(epochs, ["route", "epoch"], ["digest", "sample_id"], 400, "place")
    draws = ordered.withColumn("draw", (F.col("epoch") * F.col("n") + F.col("place") - 1) * len(routes) + turn)
    return draws.where("draw < 400").select("draw", "route", "epoch", "sample_id")


def weighted_schedule(spark, sf_dir):
    """Draws 100 to 499 of a resumed sampler over all routes, those from English twice as often as the others."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).select("sample_id", F.concat_ws("->", "source_language", "target_language").alias("route"))
    return P.draws(rows, route="route", key="sample_id", weights=_ROUTE_WEIGHTS, seed=SEED, start=100, count=400)


_LANGUAGES = ("eng_Latn", "jpn_Jpan", "kor_Hang", "zho_Hans", "zho_Hant")
_ROUTE_WEIGHTS = {f"{a}->{b}": 2 if a == "eng_Latn" else 1 for a in _LANGUAGES for b in _LANGUAGES if a != b}
_AB = "(select distinct on (id) * from hymt2_decode_ab)"
_ONCE = "(select distinct on (candidate_id) * from text_candidates)"
_ENC = "(select distinct on (sample_id) * from encoded_samples)"
_TAGS = "['eng_Latn', 'zho_Hans', 'zho_Hant', 'jpn_Jpan', 'kor_Hang']"



def _fill_sql(rows: str, budget: str) -> str:
    """Greedy fill of ``rows`` (``g, o, size``): each row in order is taken if it fits what is left of the group's budget."""
    return f"""
rows_ as (select g, o, size, row_number() over (partition by g order by o) as i from ({rows})),
walk as (
  select g, 0::bigint as i, ({budget})::bigint as room, 0::bigint as size, false as taken from rows_ group by g
  union all
  select r.g, r.i, case when r.size <= room then room - r.size else room end, r.size, r.size <= room from walk w join rows_ r on r.g = w.g and r.i = w.i + 1
)"""


_SLICED = "select concat_ws('|', coalesce(lang, 'none'), coalesce(domain, 'none')) as g, doc_id as o, length(text)::bigint as size from documents where text is not null and length(text) <= 20000"
_BALANCE = "(select min(n) from (select sum(length(text)) as n from documents where text is not null and lang is not null group by lang))"
_BALANCED = f"select lang as g, sha256('{SEED}' || chr(0) || doc_id::varchar) as o, length(text)::bigint as size from documents where text is not null and lang is not null and length(text) <= {_BALANCE}"
_BATCHES = f"""
rows_ as (select id, route, coalesce(challenger_completion_tokens, 0)::bigint as n, row_number() over (partition by route order by id) as i from {_AB}),
walk as (
  select id, route, i, n, 0::bigint as batch, 1 as held, n as total from rows_ where i = 1
  union all
  select r.id, r.route, r.i, r.n, case when held = 16 or total + r.n > 1200 then batch + 1 else batch end, case when held = 16 or total + r.n > 1200 then 1 else held + 1 end,
    case when held = 16 or total + r.n > 1200 then r.n else total + r.n end
  from walk w join rows_ r on r.route = w.route and r.i = w.i + 1
)"""
_CEILINGS = {"technical": 0.15, "legal_and_government": 0.20}


def _ceilings_sql() -> str:
    """The caps bind each other through the total: lowered in turn until a pass moves none."""
    names = list(_CEILINGS)
    state = [f"coalesce(max(n) filter (domain = '{k}'), 0)::bigint as k{i}" for i, k in enumerate(names)]
    total = f"coalesce(sum(n) filter (domain not in ({', '.join(f"'{k}'" for k in names)})), 0)::bigint as rest"
    most = lambda i, others: f"least(k{i}, floor({_CEILINGS[names[i]]}::double * ({others}) / (1 - {_CEILINGS[names[i]]}::double))::bigint)"
    one = most(0, "rest + k1")
    two = most(1, f"rest + {one}")
    cases = " ".join(f"when '{k}' then k{i}" for i, k in enumerate(names))
    return f"""
with recursive rows_ as (select candidate_id, selection_rank, coalesce(domain, 'unknown') as domain from {_ONCE} where accepted),
counts as (select domain, count(*) as n from rows_ group by domain),
caps as (select 0 as step, {', '.join(state)}, {total} from counts union all select step + 1, {one}, {two}, rest from caps where step < 200 and ({one} < k0 or {two} < k1)),
last_ as (select * from caps order by step desc limit 1),
ranked as (select *, row_number() over (partition by domain order by selection_rank nulls first, candidate_id) as r from rows_)
select domain, count(*) as kept, max(selection_rank) as last_rank from ranked, last_ where r <= (case domain {cases} else 9223372036854775807 end) group by domain"""


_PLAN = """
with recursive named as (select distinct provenance.kind as kind, source_language || '->' || target_language as route from encoded_samples where provenance.kind is not null),
kinds as (select kind, case kind when 'human_parallel' then 3 else 1 end as weight, row_number() over (order by kind) as p from (select distinct kind from named)),
draws as (
  select 0 as step, list(kind order by p) as names, list(weight order by p) as weights, list(0 order by p) as current, 0 as best from kinds
  union all
  select step + 1, names, weights,
    list_transform(range(1, len(names) + 1), lambda i: raised[i] - case when i = pick then list_sum(weights) else 0 end), pick
  from (select *, list_position(raised, list_max(raised)) as pick from (select *, list_transform(range(1, len(names) + 1), lambda i: current[i] + weights[i]) as raised from draws)) where step < 1000
),
drawn as (select names[best] as kind, count(*) as n from draws where best > 0 group by 1),
turns as (select kind, route, row_number() over (partition by kind order by route) as p, count(*) over (partition by kind) as m from named)
select t.kind, route, (n // m + case when p <= n % m then 1 else 0 end)::bigint as draws from turns t join drawn using (kind)
"""

_WEIGHTED = f"""
with recursive draws as (
  select 0 as step, {list(_ROUTE_WEIGHTS)} as names, {list(_ROUTE_WEIGHTS.values())} as weights, {[0] * len(_ROUTE_WEIGHTS)} as current, 0 as best
  union all
  select step + 1, names, weights, list_transform(range(1, len(names) + 1), lambda i: raised[i] - case when i = pick then list_sum(weights) else 0 end), pick
  from (select *, list_position(raised, list_max(raised)) as pick from (select *, list_transform(range(1, len(names) + 1), lambda i: current[i] + weights[i]) as raised from draws)) where step < 500
),
r as (select sample_id, source_language || '->' || target_language as route from {_ENC}),
sizes as (select route, count(*) as n from r group by route),
taken as (select step - 1 as draw, names[best] as route, row_number() over (partition by names[best] order by step) - 1 as nth from draws where best > 0),
placed as (select draw, route, nth // n as epoch, nth % n as place from taken join sizes using (route) where draw >= 100),
epochs as (select distinct route, epoch from placed),
ordered as (select route, epoch, sample_id, row_number() over (partition by route, epoch order by sha256('{SEED}' || chr(0) || epoch::varchar || chr(0) || sample_id), sample_id) - 1 as place from r join epochs using (route))
select draw, route, epoch, place, sample_id from placed join ordered using (route, epoch, place)"""

_CLAIMED = f"""
rows_ as (select candidate_id, list_filter([case when source_record_id is not null then 'g:' || concat_ws('|', source_id, source_record_id) end, 'e:' || {M._ID('text')}, 'n:' || {M._NEAR('text')}], lambda x: x is not null) as claims
  from {_ONCE} where accepted and text is not null)"""


def _role_sql(role: str, size: int, start: str) -> str:
    return f"""
{role}_rows as (select *, row_number() over (order by sha256('{role}' || chr(0) || candidate_id::varchar), candidate_id) as i from rows_),
{role}_walk as (
  select 0::bigint as i, {start} as used, 0 as n, false as took, null::bigint as candidate_id
  union all
  select r.i, case when n < {size} and not list_has_any(used, r.claims) then list_concat(used, r.claims) else used end,
    n + case when n < {size} and not list_has_any(used, r.claims) then 1 else 0 end, n < {size} and not list_has_any(used, r.claims), r.candidate_id
  from {role}_walk w join {role}_rows r on r.i = w.i + 1 where n < {size}
)"""


_ROLE_SELECTION = (
    f"with recursive {_CLAIMED}, {_role_sql('dev', 40, '[]::varchar[]')}, {_role_sql('train', 120, '(select used from dev_walk order by i desc limit 1)')} "
    + " union all ".join(f"select '{role}' as role, n::int as position, candidate_id from {role}_walk where took" for role, _ in _ROLES)
)

QUERIES = {
    f.__name__: f
    for f in (
        route_sample, first_per_route, language_top, bottom_candidates, sample_with_long_quota, stratified_interleave, round_robin_batches,
        review_extremes, reject_per_reason, quality_queue, domain_ceilings, host_caps, budget_fill, token_batches, sampling_plan,
        length_buckets, shard_strata, forced_review, balanced_corpus, source_bank, role_selection, composite_audit, epoch_schedule, weighted_schedule,
    )
}

SQL = {
    "role_selection": _ROLE_SELECTION,
    "weighted_schedule": _WEIGHTED,
    "domain_ceilings": _ceilings_sql(),
    "budget_fill": f"with recursive {_fill_sql(_SLICED, '20000')} select g as slice, count(*) as documents, sum(size)::bigint as characters from walk where taken group by g",
    "balanced_corpus": f"with recursive {_fill_sql(_BALANCED, _BALANCE)} select g as lang, count(*) as documents, sum(size)::bigint as characters from walk where taken group by g",
    "token_batches": f"with recursive {_BATCHES} select route, batch, count(*) as rows, sum(n)::bigint as tokens, min(id) as first_id, max(id) as last_id from walk group by route, batch",
    "sampling_plan": _PLAN,
    "route_sample": f"select * from (select id, route, sha256('{SEED}' || chr(0) || route || chr(0) || id) as digest, row_number() over (partition by route order by sha256('{SEED}' || chr(0) || route || chr(0) || id), id) as rank from {_AB}) where rank <= 10",
    "first_per_route": f"select * from (select id, route, row_number() over (partition by route order by id) as rank from {_AB}) where rank <= 5",
    "language_top": f"select * from (select candidate_id, language_tag, domain, selection_rank, row_number() over (partition by language_tag, domain order by selection_rank nulls first, candidate_id) as rank from {_ONCE} where accepted) where rank <= 20",
    "bottom_candidates": f"select candidate_id, sha256(concat_ws(chr(31), source_id, source_record_id)) as digest from {_ONCE} order by 2, 1 limit 100",
    "sample_with_long_quota": "with d as (select lang, doc_id, length(text) as characters, sha256(text) as content from documents where text is not null and text <> '' and lang is not null), o as (select *, sha256('7' || chr(0) || lang || chr(0) || content) as digest from d qualify row_number() over (partition by lang, content order by doc_id) = 1), p as (select *, row_number() over (partition by lang order by digest, doc_id) as rank from o), q as (select *, row_number() over (partition by lang order by digest, doc_id) as r2 from p where rank > 20 and characters >= 300) select lang, 'plain' as quota, rank, doc_id, characters from p where rank <= 20 union all select lang, 'long', r2, doc_id, characters from q where r2 <= 5",
    "stratified_interleave": f"with r as (select id, concat_ws('|', source_id, route) as stratum from {_AB}) select id, stratum, row_number() over (partition by stratum order by sha256(id)) as turn, sha256(stratum) as stratum_rank from r order by turn, stratum_rank, id limit 200",
    "round_robin_batches": f"with d as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as t, list_position({_TAGS}, lang) as p from documents where list_contains({_TAGS}, lang)), o as (select *, row_number() over (order by t, p) - 1 as place from d) select (place // 64)::int as batch, lang, count(*) as documents, min(place) as first_place from o group by all",
    "review_extremes": f"with r as (select id, route, length(challenger_translation) as n, {S.length_ratio('source_text', 'challenger_translation')} as r from {_AB} where challenger_filter_accepted and challenger_translation is not null), p as (select route, arg_min(id, row(n, id)) as shortest, arg_min(id, row(-n, id)) as longest, arg_min(id, row(-r, id)) as uneven from r group by 1), c as (select route, id, min(why) as why from (select route, shortest as id, 'shortest' as why from p union all select route, longest, 'longest' from p union all select route, uneven, 'uneven' from p) group by 1, 2), f as (select route, id, row_number() over (partition by route order by sha256(id), id) as k from r where id not in (select id from c)) select route, id, why from c union all select route, id, 'fill' from f where k <= 8",
    "reject_per_reason": f"with r as (select candidate_id, language_tag, reason, sha256(candidate_id::varchar) as digest from {_ONCE} where reason is not null), o as (select *, row_number() over (partition by language_tag, reason order by digest, candidate_id) = 1 as first from r), n as (select *, row_number() over (partition by language_tag order by first desc, digest, candidate_id) as rank from o) select language_tag, rank, candidate_id, reason, first from n where rank <= 10",
    "quality_queue": f"with r as (select id, route, case when challenger_filter_accepted then 'accepted' else 'rejected' end as kind, case when len(coalesce(challenger_rejection_reasons, [])) > 0 then 0 else 1 end as real, sha256(concat_ws(chr(31), route, id)) as digest from {_AB} where challenger_filter_accepted is not null), n as (select *, row_number() over (partition by route, kind order by real, digest, id) as rank from r) select route, kind, rank, id from n where rank <= 4",
    "host_caps": "with d as (select doc_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from documents where url is not null), n as (select *, row_number() over (partition by host order by sha256(doc_id::varchar), doc_id) as k from d) select host, count(*) as kept, min(doc_id) as first_doc from n where k <= 30 group by 1",
    "length_buckets": f"with r as (select sample_id, source_language, len(input_ids) as n, row_number() over (partition by source_language order by sha256(sample_id)) - 1 as p from {_ENC} where input_ids is not null), o as (select *, (p // 64)::int as pool from r), b as (select *, ((row_number() over (partition by source_language, pool order by n, sha256(sample_id)) - 1) // 16)::int as batch from o) select source_language, pool, batch, count(*) as rows, max(n)::int as longest, (count(*) * max(n) - sum(n))::bigint as padding from b group by all",
    "shard_strata": "select language, shard_id, coalesce(documents, 0) as documents, row_number() over (partition by language order by coalesce(documents, 0) desc, shard_id) as turn from corpus_manifest where language is not null order by turn, documents desc, language, shard_id limit 4",
    "forced_review": f"select id, route, coalesce(baseline_filter_accepted, false) and not coalesce(challenger_filter_accepted, true) as forced from {_AB} order by forced desc, sha256(concat_ws(chr(31), route, id)), id limit 60",
    "source_bank": f"with c as (select candidate_id, language_tag, selection_rank, {M._ID('text')} as exact, {M._NEAR('text')} as near from {_ONCE} where accepted and student_tokens between 4 and 256 and text is not null), e as (select {M._ID('text')} as exact, {M._NEAR('text')} as near from text_entries where text is not null), k as (select * from c where exact not in (select exact from e) and near not in (select near from e)), f as (select language_tag, selection_rank, candidate_id from k qualify row_number() over (partition by language_tag, near order by selection_rank nulls first, candidate_id) = 1), n as (select *, row_number() over (partition by language_tag order by selection_rank nulls first, candidate_id) as rank from f) select * from n where rank <= 40",
    "composite_audit": "with r as (select provenance.kind as kind, sample_id, sample_group_id, source_language || '->' || target_language as route, coalesce(array_to_string(input_ids, ','), chr(0)) || '|' || coalesce(array_to_string(labels, ','), chr(0)) as content from encoded_samples), s as (select sample_group_id from r where sample_group_id is not null and kind is not null group by 1 having count(distinct kind) > 1) select kind, count(*) as rows, count(distinct sample_id) as ids, count(distinct content) as contents, count(distinct route) as routes, count(*) filter (sample_group_id in (select sample_group_id from s)) as in_shared_groups from r group by 1",
    "epoch_schedule": f"with r as (select sample_id, source_language || '->' || target_language as route from {_ENC}), t as (select route, row_number() over (order by route) - 1 as turn, count(*) over () as m from (select distinct route from r)), z as (select route, count(*) as n from r group by 1), e as (select r.*, n, turn, m, unnest(range(0, 401)) as epoch from r join z using (route) join t using (route)), k as (select * from e where epoch * n * m + turn < 400), o as (select *, row_number() over (partition by route, epoch order by sha256('{SEED}' || chr(0) || epoch || chr(0) || sample_id), sample_id) - 1 as place from k) select (epoch * n + place) * m + turn as draw, route, epoch, sample_id from o where (epoch * n + place) * m + turn < 400",
}
