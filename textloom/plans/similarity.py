"""Duplicates, leakage, contamination and isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import identity as I
from textloom.functions import text as X
from textloom.operators import dedup as D
from textloom.operators import setjoin as J
from textloom.operators.graph import components
from textloom.operators.select import exact_or_near_first
from textloom.plans import sqltext as S
from textloom.session import load, spread, write_table


def _entries(spark, sf_dir):
    return load(spark, sf_dir, "text_entries").dropDuplicates(["entry_id"])


def _split(column):
    name = F.lower(F.btrim(column))
    return F.when(name.isin("valid", "validation"), F.lit("dev")).otherwise(name)


def exact_dedup(spark, sf_dir):
    """First candidate of every exact text, with its number of copies."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "text").where("text is not null").dropDuplicates(["candidate_id"])
    return rows.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("copies"))


def near_identity_dedup(spark, sf_dir):
    """First candidate of every near identity."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "text").where("text is not null").dropDuplicates(["candidate_id"])
    return rows.groupBy(D.near_identity(F.col("text")).alias("near")).agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("copies"))


def dedup_reasons(spark, sf_dir):
    """Candidates by what they duplicate: the first of their near identity exactly or nearly."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "language_tag", "text").where("text is not null").dropDuplicates(["candidate_id"])
    rows = rows.select("candidate_id", "language_tag", D.identity(F.col("text")).alias("exact"), D.near_identity(F.col("text")).alias("near"))
    marked = exact_or_near_first(rows, "near", "exact", "candidate_id")
    return marked.groupBy("language_tag", F.coalesce("duplicate", F.lit("first")).alias("duplicate")).agg(F.count("*").alias("records"))


def collision_counts(spark, sf_dir):
    """Repeated keys and surplus rows of sources, targets and pairs."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").select("id", "source_text", "baseline_translation").dropDuplicates(["id"])
    source, target = D.identity(F.col("source_text")), D.identity(F.col("baseline_translation"))
    return D.collisions(rows, {"source": source, "target": target, "pair": F.concat(source, target)})


def cross_split_texts(spark, sf_dir):
    """Texts of a language that stand in more than one split, over aligned utterances and text entries."""
    rows = load(spark, sf_dir, "locale_records").select("lang", "text", "split")
    rows = rows.unionByName(_entries(spark, sf_dir).select(F.col("language").alias("lang"), "text", F.explode("splits").alias("split")))
    return D.crossing_texts(rows.where("text is not null and text <> ''"), D.identity(F.col("text")), "lang", _split(F.col("split")))


def groups_across_splits(spark, sf_dir):
    """Sample groups whose entries list more than one split."""
    rows = _entries(spark, sf_dir).select(F.explode("groups").alias("group_id"), "splits").select("group_id", F.explode("splits").alias("s"))
    grouped = rows.select("group_id", _split(F.col("s")).alias("s")).groupBy("group_id").agg(F.array_sort(F.collect_set("s")).alias("splits"))
    return grouped.where(F.size("splits") > 1).select("group_id", F.array_join("splits", ",").alias("splits"))


def text_entry_groups(spark, sf_dir):
    """Distinct normalised texts of a language with their groups and splits."""
    rows = _entries(spark, sf_dir).select("entry_id", "language", "normalized", F.explode_outer("groups").alias("g"))
    return rows.groupBy("language", "normalized").agg(F.min("entry_id").alias("first_entry"), F.count_distinct("entry_id").alias("entries"), F.array_join(F.array_sort(F.collect_set("g")), ",").alias("groups"))


def _forms(spark, sf_dir):
    """Distinct single-spaced lower-case forms of a language."""
    rows = _entries(spark, sf_dir).select("entry_id", "language", X.collapse(F.lower("normalized")).alias("form")).where("form <> ''")
    return rows.groupBy("language", "form").agg(F.min("entry_id").alias("entry_id"))


def _similar(spark, sf_dir):
    """Distinct forms as a table, and their similar pairs within a language."""
    forms = spread(write_table(_forms(spark, sf_dir), "forms").frame)
    sides = forms.select(F.col("entry_id").alias("h"), "form", "language")
    pairs = J.similar_pairs(sides, sides, J.count_table(sides.select("form")), similar=82, both=True, block="language")
    return forms, pairs.select(F.col("left_h").alias("left_id"), F.col("right_h").alias("right_id"), "similarity")


def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of distinct forms of a language with a trigram similarity of 0.82 or more."""
    return _similar(spark, sf_dir)[1].withColumn("similarity", F.round("similarity", 6))


def band_jaccard_pairs(spark, sf_dir):
    """The same pairs through MinHash bands, counted by similarity."""
    forms = spread(write_table(_forms(spark, sf_dir), "forms").frame)
    found = D.band_pairs(forms, "entry_id", ["language"], "form", bands=60, rows=8)
    return found.groupBy(F.round("similarity", 1).alias("similarity")).agg(F.count("*").alias("pairs"))


def dedup_components(spark, sf_dir):
    """Every form's class of similar forms and its number of links."""
    forms, pairs = _similar(spark, sf_dir)
    return D.linked_classes(write_table(pairs, "pairs").frame, forms, "entry_id")


def greedy_dedup(spark, sf_dir):
    """First-wins deduplication of documents by one-permutation MinHash, by language and verdict."""
    docs = spread(load(spark, sf_dir, "documents")).select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"))
    found = D.greedy_near_duplicates(docs, "doc_id", "lang", "text")
    return found.groupBy("lang", "verdict").agg(F.count("*").alias("documents"))


def contamination_exact(spark, sf_dir):
    """Entries, documents and other passages whose exact or near identity is that of a held-out passage, whatever its match mode says."""
    entries, documents, items = load(spark, sf_dir, "text_entries", "documents", "reference_records")
    held = items.select("item_id", "policy", D.identity(F.col("text")).alias("exact"), D.near_identity(F.col("text")).alias("near")).distinct()
    rows = entries.select(F.lit("text_entries").alias("record_table"), F.col("entry_id").alias("record_id"), "text").unionByName(
        documents.select(F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), "text")
    ).unionByName(items.select(F.lit("reference_records").alias("record_table"), F.col("item_id").alias("record_id"), "text"))
    rows = rows.where("text is not null").select("record_table", "record_id", D.identity(F.col("text")).alias("exact"), D.near_identity(F.col("text")).alias("near")).distinct()
    hits = rows.join(held.select("item_id", "policy", "near", F.col("exact").alias("held")), "near")
    hits = hits.where((F.col("record_table") != "reference_records") | (F.col("record_id") != F.col("item_id")))
    return hits.select("record_table", "record_id", "item_id", "policy", F.when(F.col("exact") == F.col("held"), "exact").otherwise("near").alias("match"))


def _form_key():
    """A key of a form of a language."""
    return F.md5(F.concat_ws("\x1f", F.coalesce("language", F.lit("")), "form"))


def contamination_scan(spark, sf_dir):
    """Every held-out passage with the entries of its language that hold it, by its match mode; null where none does.

    Every entry of exactly the same text; where there is none and the mode is ``exact-and-near``, the first entry of the
    form with the highest trigram similarity of 0.82 or more, the last form in order among equals. Passages with fewer
    than five trigrams are near to none.
    """
    mode = F.coalesce("match_mode", F.lit("exact-and-near")).alias("match_mode")
    items = load(spark, sf_dir, "reference_records").where("text is not null").select("item_id", "reference_id", "policy", mode, "language", X.nfc(F.col("text")).alias("text"))
    items = write_table(items.distinct().withColumn("form", D.near_form(F.col("text"))).withColumn("h", _form_key()), "items").frame
    entries = _entries(spark, sf_dir).where("text is not null").select("entry_id", "language", X.nfc(F.col("text")).alias("text"))
    entries = write_table(spread(entries).withColumn("form", D.near_form(F.col("text"))), "entries").frame
    exact = write_table(items.join(entries.select("entry_id", "language", "text"), ["language", "text"]).select("item_id", "reference_id", "policy", "entry_id"), "exact").frame
    rest = items.where((F.col("match_mode") == "exact-and-near") & (F.size(D.trigrams(F.col("form"))) >= 5)).join(exact, ["item_id", "reference_id"], "left_anti")
    rest = rest.select("item_id", "reference_id", "policy", F.col("language").alias("held_language"), "h", "form")
    forms = entries.where("form <> ''").groupBy("language", "form").agg(F.min("entry_id").alias("entry_id")).withColumn("h", _form_key())
    forms = write_table(forms, "forms").frame
    held = write_table(rest.select("h", "form").distinct(), "held").frame
    # Pieces are ordered by the passages' own counts: what no passage holds comes first in an entry and meets nothing.
    pairs = J.similar_pairs(held, forms.select("h", "form"), J.count_table(held.select("form")), similar=82)
    same = held.join(forms.select("h"), "h").select(F.col("h").alias("left_h"), F.col("h").alias("right_h"), F.lit(1.0).cast("double").alias("similarity"))
    met = pairs.unionByName(same).join(rest.drop("form").withColumnRenamed("h", "left_h"), "left_h").join(forms.withColumnRenamed("h", "right_h"), "right_h")
    met = met.where(F.col("language").eqNullSafe(F.col("held_language"))).groupBy("item_id", "reference_id", "policy")
    near = met.agg(F.max(F.struct("similarity", "form", "entry_id")).alias("best"))
    found = exact.select("*", F.lit("exact").alias("match"), F.lit(1.0).cast("double").alias("similarity"))
    found = found.unionByName(near.select("item_id", "reference_id", "policy", "best.entry_id", F.lit("near").alias("match"), F.round("best.similarity", 6).alias("similarity")))
    return items.select("item_id", "reference_id", "policy").join(found.drop("policy"), ["item_id", "reference_id"], "left")


def contamination_sentences(spark, sf_dir):
    """Sentences of documents that equal a sentence of a held-out passage, counted by item."""
    documents, items = load(spark, sf_dir, "documents", "reference_records")
    parts = lambda c: F.explode(F.split(c, r"(?<=[。！？!?；;.])\s*|\n+"))
    held = items.select("item_id", parts("text").alias("s")).where("length(s) >= 20").select("item_id", D.near_identity(F.col("s")).alias("near")).distinct()
    rows = documents.where("text is not null").select("doc_id", parts("text").alias("s")).where("length(s) >= 20").select("doc_id", D.near_identity(F.col("s")).alias("near"))
    return rows.join(held, "near").groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("sentences"))


def isolation_overlaps(spark, sf_dir):
    """Overlap of training and evaluation entries by group, exact and near identity; 0 each if they are isolated."""
    rows = _entries(spark, sf_dir).where("normalized is not null").withColumn("s", F.explode("splits")).withColumn("s", _split(F.col("s")))
    side = F.when(F.col("s") == "train", "train").when(F.col("s").isin("dev", "test"), "held")
    rows = rows.withColumn("side", side).where("side is not null")
    keys = F.array(F.struct(F.lit("exact").alias("kind"), D.identity(F.col("normalized")).alias("key")), F.struct(F.lit("near").alias("kind"), D.near_identity(F.col("normalized")).alias("key")))
    flat = rows.select("side", F.explode(keys).alias("k")).select("side", "k.*")
    flat = flat.unionByName(rows.select("side", F.lit("group").alias("kind"), F.explode("groups").alias("key")))
    both = flat.groupBy("kind", "key").agg(F.count_distinct("side").alias("sides"))
    return both.groupBy("kind").agg(F.count("*").alias("keys"), F.count_if(F.col("sides") > 1).alias("shared"))


def group_components(spark, sf_dir):
    """Sample groups tied by entries that list them together, by smallest member; `component_splits` ties them by texts too."""
    rows = _entries(spark, sf_dir).select("entry_id", F.explode("groups").alias("group_id"))
    return components(rows, "entry_id", "group_id").select(F.col("entity").alias("group_id"), F.col("component").alias("component_id"))


def component_splits(spark, sf_dir):
    """Component and split of every sample group: groups tied by one text or by similar texts of a language are split together.

    Ties are an entry's own list, equal near forms, and near forms with a trigram similarity of 0.82 or more (of at least
    five trigrams each). A component's id is the digest of its sorted members, which meet in one row; the split follows
    from the id.
    """
    entries = spread(_entries(spark, sf_dir)).select("entry_id", "language", D.near_form(F.col("text")).alias("form"), F.explode("groups").alias("g")).where("g is not null")
    key = F.when(F.col("form") != "", _form_key()).otherwise(F.concat(F.lit("entry:"), F.col("entry_id").cast("string")))
    rows = write_table(entries.withColumn("h", key), "tied").frame
    forms = rows.where("form <> ''").groupBy("h").agg(F.any_value("language").alias("language"), F.any_value("form").alias("form"), F.min("g").alias("g"))
    forms = write_table(forms.where(F.size(D.trigrams(F.col("form"))) >= 5), "forms").frame
    sides = spread(forms).select("h", "form", "language")
    pairs = J.similar_pairs(sides, sides, J.count_table(sides.select("form")), similar=82, both=True, block="language")
    one, other = (forms.select(F.col("h").alias(f"{s}_h"), F.col("g").alias(f"{s}_g")) for s in ("left", "right"))
    near = pairs.join(one, "left_h").join(other, "right_h")
    # One group of each form is enough: the others are tied to it through the form.
    near = near.select(F.concat_ws("|", "left_h", "right_h").alias("r"), F.explode(F.array("left_g", "right_g")).alias("g"))
    lists = rows.select(F.concat(F.lit("entry:"), F.col("entry_id").cast("string")).alias("r"), "g")
    alone = load(spark, sf_dir, "encoded_samples").where("sample_group_id is not null").select(F.concat(F.lit("group:"), F.col("sample_group_id")).alias("r"), F.col("sample_group_id").alias("g"))
    placed = components(rows.select(F.col("h").alias("r"), "g").unionByName(lists).unionByName(near).unionByName(alone), "r", "g")
    whole = placed.groupBy("component").agg(F.array_sort(F.collect_list("entity")).alias("members"))
    whole = whole.select("members", F.concat(F.lit("component-sha256:"), I.sha(F.concat(F.to_json("members"), F.lit("\n")))).alias("component_id"))
    digest = I.sha(I.canonical_json({"component_id": F.col("component_id"), "split_profile_version": F.lit("massive-locked-count-hash-v1")}))
    return whole.withColumn("split", I.split_of(digest)).select(F.explode("members").alias("sample_group_id"), "component_id", "split")


_TE = "(select distinct on (entry_id) * from text_entries)"
_ONCE = "(select distinct on (candidate_id) * from text_candidates)"
_ID = lambda t: f"sha256(lower({S.collapse(t)}))"
_NEAR = lambda t: f"sha256({S.strip(f'lower({t})', f'[\\p{{P}}\\p{{S}}\\p{{Z}}{X.WHITE}]')})"
_SPLIT = lambda c: f"(case when lower(trim({c})) in ('valid', 'validation') then 'dev' else lower(trim({c})) end)"
_SENT = "regexp_split_to_array(regexp_replace(text, '([。！？!?；;.])', '\\1' || chr(10), 'g'), '\\s*\\n+\\s*')"
_FORMS = f"forms as (select language, form, min(entry_id) as entry_id from (select entry_id, language, {S.collapse('lower(normalized)')} as form from {_TE}) where form <> '' group by all)"
_GRAMS = "grams as (select distinct entry_id, language, substr('^' || form || '$', i, 3) as g from (select *, unnest(range(1, length(form) + 1)) as i from forms)), sizes as (select entry_id, count(*) as n from grams group by 1)"
_SIM = f"{_FORMS}, {_GRAMS}, both_ as (select a.entry_id as left_id, b.entry_id as right_id, count(*) as c from grams a join grams b on a.g = b.g and a.language is not distinct from b.language and a.entry_id < b.entry_id group by all), pairs as (select left_id, right_id, c / (x.n + y.n - c) as similarity from both_ join sizes x on x.entry_id = left_id join sizes y on y.entry_id = right_id where c / (x.n + y.n - c) >= 0.82)"
_IDENT = f"rows_ as (select distinct record_table, record_id, {_ID('text')} as exact, {_NEAR('text')} as near from (select 'text_entries' as record_table, entry_id as record_id, text from text_entries union all select 'documents', doc_id, text from documents union all select 'reference_records', item_id, text from reference_records) where text is not null)"

_NF = lambda t: f"nfc_normalize({t})"
_LOW = lambda t: S.collapse(f"lower({_NF(t)})")
_SCAN = f"""
with items as (select distinct item_id, reference_id, policy, coalesce(match_mode, 'exact-and-near') as mode, language, {_NF('text')} as t, {_LOW('text')} as form from reference_records where text is not null),
ent as (select entry_id, language, {_NF('text')} as t, {_LOW('text')} as form from {_TE} where text is not null),
exact as (select item_id, reference_id, entry_id from items join ent using (language, t)),
forms as (select language, form, min(entry_id) as entry_id from ent where form <> '' group by all),
rest as (select * from items where mode = 'exact-and-near' and (item_id, reference_id) not in (select (item_id, reference_id) from exact)),
igrams as (select distinct item_id, reference_id, language, substr('^' || form || '$', i, 3) as g from (select *, unnest(range(1, length(form) + 1)) as i from rest)),
isizes as (select item_id, reference_id, count(*) as n from igrams group by all),
fgrams as (select distinct language, form, substr('^' || form || '$', i, 3) as g from (select *, unnest(range(1, length(form) + 1)) as i from forms)),
fsizes as (select language, form, count(*) as n from fgrams group by all),
met as (select item_id, reference_id, f.language, form, count(*) as c from igrams i join fgrams f on i.g = f.g and i.language is not distinct from f.language group by all),
scored as (select item_id, reference_id, form, entry_id, c / (s.n + z.n - c) as similarity from met m join isizes s using (item_id, reference_id) join fsizes z using (language, form) join forms f using (language, form) where s.n >= 5),
near as (select *, row_number() over (partition by item_id, reference_id order by similarity desc, form desc, entry_id desc) as k from scored where similarity >= 0.82),
found as (select item_id, reference_id, entry_id, 'exact' as match, 1.0::double as similarity from exact union all select item_id, reference_id, entry_id, 'near', round(similarity, 6) from near where k = 1)
select item_id, reference_id, policy, entry_id, match, similarity from (select distinct item_id, reference_id, policy, mode, language, t from items) left join found using (item_id, reference_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup, near_identity_dedup, dedup_reasons, collision_counts, cross_split_texts, groups_across_splits, text_entry_groups,
        shingle_jaccard_pairs, band_jaccard_pairs, dedup_components, greedy_dedup, contamination_exact, contamination_scan, contamination_sentences, isolation_overlaps, group_components,
        component_splits,
    )
}

SQL = {
    "contamination_scan": _SCAN,
    "exact_dedup": f"select sha256(text) as content, min(candidate_id) as candidate_id, count(*) as copies from {_ONCE} where text is not null group by 1",
    "near_identity_dedup": f"select {_NEAR('text')} as near, min(candidate_id) as candidate_id, count(*) as copies from {_ONCE} where text is not null group by 1",
    "dedup_reasons": f"with r as (select candidate_id, language_tag, {_ID('text')} as exact, {_NEAR('text')} as near from {_ONCE} where text is not null), m as (select *, row_number() over w as n, first_value(exact) over w as f from r window w as (partition by near order by candidate_id)) select language_tag, case when n = 1 then 'first' when f = exact then 'exact_duplicate' else 'near_duplicate' end as duplicate, count(*) as records from m group by all",
    "collision_counts": f"with r as (select distinct on (id) id, {_ID('source_text')} as s, {_ID('baseline_translation')} as t from hymt2_decode_ab), k as (select 'source' as field, s as key, count(*) as n from r group by all union all select 'target', t, count(*) from r group by all union all select 'pair', s || t, count(*) from r group by all) select field, count(*) filter (n > 1) as keys, coalesce(sum(n - 1) filter (n > 1), 0)::bigint as surplus from k group by field",
    "cross_split_texts": f"with r as (select lang as language, {_ID('text')} as text_digest, {_SPLIT('split')} as s from (select lang, text, split from locale_records union all select language, text, unnest(splits) from {_TE}) where text is not null and text <> '' and split is not null) select language, text_digest, string_agg(distinct s, ',' order by s) as splits, count(*) as records from r group by 1, 2 having count(distinct s) > 1",
    "groups_across_splits": f"with g as (select entry_id, unnest(groups) as group_id, splits from {_TE}), s as (select group_id, {_SPLIT('s')} as s from (select group_id, unnest(splits) as s from g)) select group_id, string_agg(distinct s, ',' order by s) as splits from s group by 1 having count(distinct s) > 1",
    "text_entry_groups": f"with g as (select entry_id, language, normalized, unnest(case when len(groups) > 0 then groups else [null] end) as g from {_TE}) select language, normalized, min(entry_id) as first_entry, count(distinct entry_id) as entries, coalesce(string_agg(distinct g, ',' order by g), '') as groups from g group by 1, 2",
    "shingle_jaccard_pairs": f"with {_SIM} select left_id, right_id, round(similarity, 6) as similarity from pairs",
    "band_jaccard_pairs": f"with {_SIM} select round(similarity, 1) as similarity, count(*) as pairs from pairs group by 1",
    "dedup_components": f"with recursive {_SIM}, edges as (select left_id as a, right_id as b from pairs union select right_id, left_id from pairs), reach as (select entry_id, entry_id as r from forms union select reach.entry_id, edges.b from reach join edges on edges.a = reach.r), comp as (select entry_id, min(r) as class_id from reach group by 1), links as (select a, count(*) as n from edges group by 1) select comp.entry_id, class_id, coalesce(n, 0) as links from comp left join links on a = comp.entry_id",
    "contamination_exact": f"with {_IDENT}, h as (select distinct item_id, policy, {_ID('text')} as held, {_NEAR('text')} as near from reference_records) select record_table, record_id, item_id, policy, case when exact = held then 'exact' else 'near' end as match from rows_ join h using (near) where record_table <> 'reference_records' or record_id <> item_id",
    "contamination_sentences": f"with h as (select distinct item_id, {_NEAR('s')} as near from (select item_id, unnest({_SENT}) as s from reference_records) where length(s) >= 20), d as (select doc_id, {_NEAR('s')} as near from (select doc_id, unnest({_SENT}) as s from documents where text is not null) where length(s) >= 20) select item_id, count(distinct doc_id) as documents, count(*) as sentences from d join h using (near) group by 1",
    "isolation_overlaps": f"with r as (select groups, normalized, {_SPLIT('s')} as s from (select *, unnest(splits) as s from {_TE} where normalized is not null)), t as (select *, case when s = 'train' then 'train' else 'held' end as side from r where s in ('train', 'dev', 'test')), k as (select side, 'exact' as kind, {_ID('normalized')} as key from t union all select side, 'near', {_NEAR('normalized')} from t union all select side, 'group', unnest(groups) from t), b as (select kind, key, count(distinct side) as sides from k group by all) select kind, count(*) as keys, count(*) filter (sides > 1) as shared from b group by 1",
    "group_components": f"with recursive t as (select distinct entry_id, unnest(groups) as g from {_TE}), n as (select distinct a.g as a, b.g as b from t a join t b using (entry_id)), reach as (select distinct g, g as r from t where g is not null union select reach.g, n.b from reach join n on n.a = reach.r) select g as group_id, min(r) as component_id from reach group by 1",
}
