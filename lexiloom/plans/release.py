"""Building and checking a release: distractors, alignments, contamination, evidence, validation, reports."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import sampling as S
from lexiloom.plans.cleaning import NORM
from lexiloom.plans.registry import query
from lexiloom.plans.sampled import FIRST, JUDGED, predictions, rows_
from lexiloom.plans.session import looked_up

# Joins


@query("j4_object_lookup", "flat", "parallel", sql="""select f.row_id, p.object_id from flat f join (select fact_id, arg_min(object_id, row_id) as object_id from parallel where fact_id is not null and object_id is not null group by 1) p on f.fact_id = p.fact_id""")
def object_lookup(flat, parallel):
    p = parallel.where("fact_id is not null and object_id is not null").groupBy("fact_id").agg(F.min_by("object_id", "row_id").alias("object_id"))
    return flat.select("row_id", "fact_id").join(p, "fact_id").select("row_id", "object_id")


@query("j14_index_parallel", "flat", sql="""select fact_id, count(*) as n_langs, max(pool) as pool from (select fact_id, language, arg_min(len(list_filter([option_a, option_b, option_c, option_d], lambda x: x is not null)), row_id) as pool from flat where fact_id is not null group by 1, 2) group by 1 having count(distinct pool) = 1""")
def index_parallel(flat):
    """Facts whose option pools have one size in all of their languages, so that positions can be aligned."""
    pool = F.size(F.array_compact(F.array(*[f"option_{c}" for c in "abcd"])))
    per = flat.where("fact_id is not null").groupBy("fact_id", "language").agg(F.min_by(pool, "row_id").alias("pool"))
    return per.groupBy("fact_id").agg(rows_().alias("n_langs"), F.max("pool").alias("pool"), F.countDistinct("pool").alias("sizes")).where("sizes = 1").drop("sizes")


_SIDES = f"""t as (select distinct property_id as p, {NORM.format('subject')} as s, {NORM.format('object')} as o from parallel where split = 'train' and property_id is not null and subject is not null and object is not null),
 e as (select row_id, relation, property_id as p, {NORM.format('subject')} as s, {NORM.format('object')} as o from parallel where split = 'test' and property_id is not null and subject is not null and object is not null)"""


def sides(parallel):
    """(train triples, test rows) in normalised English."""
    x = parallel.where("property_id is not null and subject is not null and object is not null")
    x = x.select("row_id", "relation", "split", F.col("property_id").alias("p"), T.norm(F.col("subject")).alias("s"), T.norm(F.col("object")).alias("o"))
    return x.where("split = 'train'").select("p", "s", "o").distinct(), x.where("split = 'test'").drop("split")


def held_in(rows, keys, name: str):
    """rows with a flag: whether their key columns stand in `keys`, in any other columns' company."""
    return rows.join(keys.distinct().withColumn(name, F.lit(True)), keys.columns, "left").withColumn(name, F.coalesce(name, F.lit(False)))


@query("j15_triple_overlap", "parallel", sql=f"""with {_SIDES}, u as (select distinct p, s, o from e) select (select count(*) from t) as n_train, (select count(*) from u) as n_test, (select count(*) from u where (p, s, o) in (select (p, s, o) from t)) as shared_triples,
 (select count(*) from (select distinct p, s from u where (p, s) in (select (p, s) from t))) as shared_pairs, (select count(*) from t where (p, s) in (select (p, s) from u)) as train_of_pairs""")
def triple_overlap(parallel):
    t, e = sides(parallel)
    both = t.withColumn("w", F.lit(1)).union(e.select("p", "s", "o").distinct().withColumn("w", F.lit(2))).groupBy("p", "s", "o").agg(F.sum("w").alias("w"))
    per = both.groupBy("p", "s").agg(F.count_if(F.col("w").isin(1, 3)).alias("a"), F.count_if(F.col("w") >= 2).alias("b"), F.count_if(F.col("w") == 3).alias("c"))
    pair = (F.col("a") > 0) & (F.col("b") > 0)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(n("a").alias("n_train"), n("b").alias("n_test"), n("c").alias("shared_triples"), F.count_if(pair).alias("shared_pairs"), n(F.when(pair, F.col("a"))).alias("train_of_pairs"))


@query("j16_contamination_labels", "parallel", sql=f"""with {_SIDES}, f as (select p, s, arg_min(o, row_id) as o, min(row_id) as row_id from e group by 1, 2)
 select row_id, case when (p, s, o) in (select (p, s, o) from t) then 'contaminated' when (p, s) in (select (p, s) from t) then 'clean, shared key' else 'clean' end as label from f""")
def contamination_labels(parallel):
    """The first test row of each (property, subject): its triple stands in train, only its key does, or neither."""
    t, e = sides(parallel)
    first = e.groupBy("p", "s").agg(F.min(F.struct("row_id", "o")).alias("m")).select("p", "s", "m.*")
    x = held_in(held_in(first, t, "triple"), t.select("p", "s"), "key")
    return x.select("row_id", F.when(F.col("triple"), "contaminated").when(F.col("key"), "clean, shared key").otherwise("clean").alias("label"))


@query("j19_strict_pairs", "parallel", sql=f"""with {_SIDES} select relation, count(*) as n, count(*) filter (where (s, o) in (select (s, o) from t)) as pairs, count(*) filter (where (p, s, o) in (select (p, s, o) from t)) as strict from e group by 1""")
def strict_pairs(parallel):
    t, e = sides(parallel)
    x = held_in(held_in(e, t, "strict"), t.select("s", "o"), "pair")
    return x.groupBy("relation").agg(rows_().alias("n"), F.count_if("pair").alias("pairs"), F.count_if("strict").alias("strict"))


_GRAMS = rf"""g as (select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select doc_id, w, unnest([1, 2, 3, 4, 5, 6]) as n from (select doc_id, string_split({NORM.format('text')}, ' ') as w from documents where text is not null))))"""


def phrases_in(documents, phrases):
    """(doc_id, phrase) of the phrases, one a row, that stand in a text as whole words, up to six of them.

    A run of words is only made where its first word begins a phrase, and only in the lengths that
    phrases with that word have, so what is looked up doesn't grow with six times the corpus.
    """
    heads = phrases.groupBy(F.split("phrase", " ")[0].alias("head")).agg(F.collect_set(F.size(F.split("phrase", " "))).alias("sizes"))  # at most six
    words = documents.where("text is not null").select("doc_id", F.explode(F.array(F.split(T.norm(F.col("text")), " "))).alias("w"))
    at = words.select("doc_id", F.inline(F.transform("w", lambda x, i: F.struct(x.alias("head"), F.slice("w", i + 1, 6).alias("run")))))
    runs = looked_up(at, heads, ["head"]).select("doc_id", "run", F.explode("sizes").alias("n")).where("n <= size(run)")
    found = runs.select("doc_id", F.array_join(F.slice("run", 1, F.col("n")), " ").alias("phrase"))
    return looked_up(found, phrases, ["phrase"], "left_semi").distinct()


@query("j17_co_mention", "documents", "parallel", sql=rf"""with {_GRAMS}, f as (select distinct fact_id, {NORM.format('subject')} as s, {NORM.format('object')} as o from parallel where fact_id is not null and length({NORM.format('subject')}) >= 4 and length({NORM.format('object')}) >= 4)
 select fact_id, count(distinct a.doc_id) as n_docs from f join g a on a.phrase = s join g b on b.phrase = o and a.doc_id = b.doc_id group by 1""")
def co_mention(documents, parallel):
    """Facts by the documents that name their subject and their object (names of up to six words, of any language of text)."""
    s, o = T.norm(F.col("subject")), T.norm(F.col("object"))
    f = parallel.select("fact_id", s.alias("s"), o.alias("o")).where("fact_id is not null and length(s) >= 4 and length(o) >= 4").distinct()
    names = f.select(F.explode(F.array("s", "o")).alias("phrase")).distinct().where("size(split(phrase, ' ')) <= 6")
    hits = phrases_in(documents, names)
    by_subject = f.join(hits.select("doc_id", F.col("phrase").alias("s")), "s")
    both = by_subject.join(hits.select("doc_id", F.col("phrase").alias("o")), ["doc_id", "o"])
    return both.groupBy("fact_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("j18_reuse_pairs", "documents", "eval_items", sql=rf"""with b as (select distinct item_id, array_to_string(w[i:i + 7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as i from (select item_id, string_split({NORM.format('passage')}, ' ') as w from eval_items where passage is not null))),
 d as (select distinct doc_id, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from (select doc_id, string_split({NORM.format('text')}, ' ') as w from documents where text is not null)))
 select item_id, doc_id, count(*) as n_grams from b join d using (g) group by 1, 2""")
def reuse_pairs(documents, items):
    """Items and documents that share runs of eight words, in all languages written with spaces.

    Hashes of the items' runs go to all tasks if they are few enough, so the corpus' runs aren't shuffled.
    """
    words = lambda c: F.explode(F.array(F.split(T.norm(F.col(c)), " "))).alias("w")
    gram = F.explode(T.ngrams(F.col("w"), 8)).alias("g")
    b = items.where("passage is not null").select("item_id", words("passage")).select("item_id", gram).distinct()
    d = documents.where("text is not null").select("doc_id", words("text")).select("doc_id", gram)
    hit = looked_up(d, b.select("g").distinct(), ["g"], "left_semi").distinct()
    return hit.join(b, "g").groupBy("item_id", "doc_id").agg(rows_().alias("n_grams"))


@query("j24_without_drops", "flat", sql=f"""with d as (select distinct fact_id from flat where question is null and fact_id is not null) select language, count(*) as n_all, round(avg((pred = gold)::int), 6) as all_right, count(*) filter (where fact_id not in (select fact_id from d)) as n_kept,
 round(avg((pred = gold)::int) filter (where fact_id not in (select fact_id from d)), 6) as kept_right from {JUDGED} group by 1""")
def without_drops(flat):
    """Accuracy per language with and without the facts of a drop list (those with a row that lacks its question)."""
    drop = flat.where("question is null and fact_id is not null").select("fact_id").distinct().withColumn("dropped", F.lit(True))
    x = predictions(flat).join(drop, "fact_id", "left").withColumn("r", F.col("correct").cast("int"))
    kept = F.col("dropped").isNull()
    return x.groupBy("language").agg(rows_().alias("n_all"), F.round(F.avg("r"), 6).alias("all_right"), F.count_if(kept).alias("n_kept"), F.round(F.avg(F.when(kept, F.col("r"))), 6).alias("kept_right"))


@query("j28_bilingual_pairs", "parallel", sql="select row_id, translations['en'].answer_text as en, translations['de'].answer_text as de from parallel where translations['en'].answer_text is not null and translations['de'].answer_text is not null")
def bilingual_pairs(parallel):
    both = parallel.select("row_id", *[F.col("translations")[x]["answer_text"].alias(x) for x in ("en", "de")])
    return both.where("en is not null and de is not null")


@query("j31_open_proposals", "flat", sql="""select distinct fact_id, language from flat where question is null and fact_id is not null and (fact_id, language) not in (select (fact_id, language) from flat where question_regenerated and fact_id is not null)""")
def open_proposals(flat):
    """(fact, language) that lack a question and for which none was made anew before."""
    done = flat.where("question_regenerated and fact_id is not null").select("fact_id", "language").distinct()
    return flat.where("question is null and fact_id is not null").select("fact_id", "language").distinct().join(done, ["fact_id", "language"], "left_anti")


@query("j20_verdict_join", "flat", "parallel", sql="""with p as (select fact_id, arg_min(translations, row_id) as t from parallel where fact_id is not null group by 1), n as (select fact_id, unnest(map_keys(t)) as language, unnest(map_values(t)).question_verified as v from p)
 select f.language, count(*) as n, count(*) filter (where question_verified is not distinct from v) as same, count(*) filter (where v is null and question_verified is not null) as missing from flat f join n on f.fact_id = n.fact_id and f.language = n.language group by 1""")
def verdict_join(flat, parallel):
    """Verdicts of flat rows against those nested in parallel, by fact and language."""
    p = parallel.where("fact_id is not null").groupBy("fact_id").agg(F.min(F.struct("row_id", F.map_entries(F.transform_values("translations", lambda k, t: t["question_verified"])).alias("t"))).alias("m"))
    n = p.select("fact_id", F.inline("m.t")).withColumnsRenamed({"key": "language", "value": "v"})
    x = flat.select("fact_id", "language", "question_verified").join(n, ["fact_id", "language"])
    q, v = F.col("question_verified"), F.col("v")
    return x.groupBy("language").agg(rows_().alias("n"), F.count_if(q.eqNullSafe(v)).alias("same"), F.count_if(v.isNull() & q.isNotNull()).alias("missing"))


# Alignment of options by their texts

_PERMS = list(itertools.permutations(range(4)))
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0})) + 1), lambda i: substr({0}, i, 2)))"
_ROWS = """r as (select fact_id, language, arg_min({a: option_a, b: option_b, c: option_c, d: option_d, g: answer_index}, row_id) as o from flat
 where fact_id is not null and option_a is not null and option_b is not null and option_c is not null and option_d is not null group by 1, 2),
 n as (select fact_id, language, o.g as gold, """ + ", ".join(f"{NORM.format(f'o.{c}')} as t{i}" for i, c in enumerate("abcd")) + """ from r),
 k as (select *, """ + ", ".join(_BIGRAMS.format(f"t{i}") + f" as g{i}" for i in range(4)) + """ from n),
 j as (select x.fact_id, x.language, e.gold as eg, x.gold as xg, """ + ", ".join(f"e.t{i} as et{i}, x.t{i} as xt{i}, e.g{i} as eg{i}, x.g{i} as xg{i}" for i in range(4)) + """ from k x join k e on x.fact_id = e.fact_id where e.language = 'en' and x.language <> 'en')"""
_LIKE = "((len(list_intersect(eg{0}, xg{1})) * 1000000) // len(list_distinct(list_concat(eg{0}, xg{1}))))"
_SCORE = "(coalesce(case when eg = {0} and xg = {1} then 1000000000 end, 0) + (case when et{0} = xt{1} then 100000000 else 0 end) + " + _LIKE + ")"


def bigrams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.substring(c, i, F.lit(2))))


def paired_options(flat):
    """(fact_id, language, eg, xg, and of each of four options of the English row (e) and the other (x) its
    normalised text and bigrams): the first row of each fact and language that has four options."""
    rows = flat.where("fact_id is not null").na.drop(subset=[f"option_{c}" for c in "abcd"])
    first = rows.groupBy("fact_id", "language").agg(F.min(F.struct("row_id", *[f"option_{c}" for c in "abcd"])).alias("m"), F.min_by("answer_index", "row_id").alias("gold"))
    n = first.select("fact_id", "language", "gold", *[T.norm(F.col(f"m.option_{c}")).alias(f"t{i}") for i, c in enumerate("abcd")])
    k = n.select("*", *[bigrams(F.col(f"t{i}")).alias(f"g{i}") for i in range(4)])
    e = k.where("language = 'en'").select("fact_id", F.col("gold").alias("eg"), *[F.col(f"{c}{i}").alias(f"e{c}{i}") for i in range(4) for c in "tg"])
    x = k.where("language <> 'en'").select("fact_id", "language", F.col("gold").alias("xg"), *[F.col(f"{c}{i}").alias(f"x{c}{i}") for i in range(4) for c in "tg"])
    return x.join(e, "fact_id")


def likeness(i: int, j: int) -> Column:
    """Shared bigrams of all that either text has, in whole millionths, so that sums and ties are exact."""
    return F.expr(f"size(array_intersect(eg{i}, xg{j})) * 1000000L div size(array_union(eg{i}, xg{j}))")


@query("j12_option_assignment", "flat", sql=f"""with {_ROWS}, s as (select fact_id, language, {", ".join(_SCORE.format(i, j) + f" as s{i}{j}" for i in range(4) for j in range(4))} from j)
 select fact_id, language, list_sort([{", ".join(f"{{'t': -({' + '.join(f's{i}{j}' for i, j in enumerate(p))}), 'k': {n}, 'p': '{','.join(map(str, p))}'}}" for n, p in enumerate(_PERMS))}])[1].p as slots from s""")
def option_assignment(flat):
    """Each English option's position in the other language's row: the gold answers belong together, then equal
    normalised texts do, and the rest is the assignment of largest bigram overlap, which the last pair follows from.

    The three stages are one sum over the 24 permutations, as each weighs more than all that come after it.
    """
    x = paired_options(flat)
    score = lambda i, j: F.coalesce(F.when((F.col("eg") == i) & (F.col("xg") == j), 1_000_000_000), F.lit(0)) + F.when(F.col(f"et{i}") == F.col(f"xt{j}"), 100_000_000).otherwise(0) + likeness(i, j)
    s = x.select("fact_id", "language", *[score(i, j).alias(f"s{i}{j}") for i in range(4) for j in range(4)])
    every = [F.struct((-sum((F.col(f"s{i}{j}") for i, j in list(enumerate(p))[1:]), F.col(f"s0{p[0]}"))).alias("t"), F.lit(n).alias("k"), F.lit(",".join(map(str, p))).alias("p")) for n, p in enumerate(_PERMS)]
    return s.select("fact_id", "language", F.array_min(F.array(*every))["p"].alias("slots"))


_GREEDY = "list_sort([" + ", ".join(f"{{'t': -{_LIKE.format(i, j)}, 'i': {i}, 'j': {j}}}" for i in range(4) for j in range(4)) + "])"


@query("j13_greedy_alignment", "flat", sql=f"""with {_ROWS}, a as (select fact_id, language, {_GREEDY} as l from j), b as (select *, list_filter(l, lambda p: p.i <> l[1].i and p.j <> l[1].j) as m from a), c as (select *, list_filter(m, lambda p: p.i <> m[1].i and p.j <> m[1].j) as n from b), d as (select *, list_filter(n, lambda p: p.i <> n[1].i and p.j <> n[1].j) as o from c)
 select fact_id, language, array_to_string(list_transform(list_sort([l[1].i * 10 + l[1].j, m[1].i * 10 + m[1].j, n[1].i * 10 + n[1].j, o[1].i * 10 + o[1].j]), lambda x: x % 10), ',') as slots from d""")
def greedy_alignment(flat):
    """The same by repeatedly taking the most alike pair that is left, the first by position on a tie."""
    pairs = F.array_sort(F.array(*[F.struct((-likeness(i, j)).alias("t"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)]))
    x = paired_options(flat).select("fact_id", "language", pairs.alias("l0"))
    for n in range(3):
        x = x.withColumn(f"l{n + 1}", F.expr(f"filter(l{n}, p -> p.i <> l{n}[0].i and p.j <> l{n}[0].j)"))
    taken = F.array_sort(F.array(*[F.col(f"l{n}")[0]["i"] * 10 + F.col(f"l{n}")[0]["j"] for n in range(4)]))
    return x.select("fact_id", "language", F.array_join(F.transform(taken, lambda v: (v % 10).cast("string")), ",").alias("slots"))


# Distractors and samples

_RING = "[lead(object_id, 1) over {0}, lead(object_id, 2) over {0}, lead(object_id, 3) over {0}, nth_value(object_id, 1) over {0}a, nth_value(object_id, 2) over {0}a, nth_value(object_id, 3) over {0}a]"
_ALL = "rows between unbounded preceding and unbounded following"


@query("d1_typed_distractors", "parallel", "entity_types", "entity_labels", sql=f"""with o as (select distinct property_id, object_id from parallel where property_id is not null and object_id is not null), t as (select id, list_min(types) as type from (select id, flatten(list(types)) as types from entity_types group by 1)),
 l as (select id, max(labels['en']) as label from entity_labels group by 1), x as (select property_id, object_id, coalesce(type, '') as type, length(label) // 16 as band, md5(object_id) as h from o join l on l.id = object_id left join t on t.id = object_id where label is not null),
 r as (select property_id, object_id, {_RING.format('a')} as r1, {_RING.format('b')} as r2, {_RING.format('c')} as r3 from x window a as (partition by property_id, type, band order by h, object_id), aa as (partition by property_id, type, band order by h, object_id {_ALL}),
 b as (partition by property_id, band order by h, object_id), ba as (partition by property_id, band order by h, object_id {_ALL}), c as (partition by property_id order by h, object_id), ca as (partition by property_id order by h, object_id {_ALL})),
 u as (select property_id, object_id, list_filter(list_concat(list_concat(r1, r2), r3), lambda v: v is not null and v <> object_id) as v from r),
 d as (select property_id, object_id, list_filter(v, lambda y, i: list_position(v, y) = i)[1:3] as v from u) select property_id, object_id, array_to_string(v, ',') as distractors from d where len(v) = 3""")
def typed_distractors(parallel, types, labels):
    """Three distractors for each object of a property, none where there are fewer.

    Tiers: objects of the property of the same type and length band, then of the same band, then any. Within
    a tier objects stand in a ring by hash and each takes those that follow it, so a draw needs one sort a
    tier and no pairs; a type is an object's smallest, a band is sixteen lengths of the English label.
    """
    o = parallel.select("property_id", "object_id").where("property_id is not null and object_id is not null").distinct()
    t = types.groupBy(F.col("id").alias("object_id")).agg(F.min(F.array_min("types")).alias("type"))
    en = labels.groupBy(F.col("id").alias("object_id")).agg(F.max(F.col("labels")["en"]).alias("label")).where("label is not null")
    x = o.join(en, "object_id").join(t, "object_id", "left").select("property_id", "object_id", F.coalesce("type", F.lit("")).alias("type"), F.floor(F.length("label") / 16).alias("band"), F.md5("object_id").alias("h"))
    rings = []
    for by in (["property_id", "type", "band"], ["property_id", "band"], ["property_id"]):
        w = Window.partitionBy(*by).orderBy("h", "object_id")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rings += [F.lead("object_id", i).over(w) for i in (1, 2, 3)] + [F.nth_value("object_id", i).over(whole) for i in (1, 2, 3)]
    v = x.select("property_id", "object_id", F.array_distinct(F.array_compact(F.array(*rings))).alias("v"))
    v = v.select("property_id", "object_id", F.slice(F.filter("v", lambda y: y != F.col("object_id")), 1, 3).alias("v"))
    return v.where("size(v) = 3").select("property_id", "object_id", F.array_join("v", ",").alias("distractors"))


@query("d4_capped_total", "parallel", sql="""with c as (select relation, object_id, count(*) as n from parallel where relation is not null and object_id is not null group by 1, 2),
 w as (select relation, n, row_number() over v as m, sum(n) over (partition by relation) - sum(n) over (v rows unbounded preceding) as rest, lead(n) over v as next from c window v as (partition by relation order by n desc, object_id)),
 z as (select relation, 0 as m, sum(n) as rest, max(n) as next from c group by 1 union all select relation, m, rest, next from w), t as (select relation, m, rest / (1 - m * 0.2::double) as t, next from z where m * 0.2::double < 0.999)
 select relation, arg_min(m, m)::bigint as n_capped, round(arg_min(t, m), 4) as total, floor(0.2::double * arg_min(t, m) + 1e-6)::bigint as cap from t where coalesce(next, 0) <= 0.2::double * t + 1e-9 group by 1""")
def capped_total(parallel):
    """The largest total of a relation's rows of which no object holds more than a fifth: T = sum(min(n, T / 5)).

    With the m most frequent objects capped, T is what the others hold over 1 - m / 5; the smallest m with
    which the next object keeps under the cap gives T. Relations with under five objects have none.
    """
    share = 0.2
    c = parallel.where("relation is not null and object_id is not null").groupBy("relation", "object_id").agg(rows_().alias("n"))
    v = Window.partitionBy("relation").orderBy(F.desc("n"), "object_id")
    w = c.select("relation", F.row_number().over(v).alias("m"), (F.sum("n").over(Window.partitionBy("relation")) - F.sum("n").over(v.rowsBetween(Window.unboundedPreceding, 0))).alias("rest"), F.lead("n").over(v).alias("next"))
    z = c.groupBy("relation").agg(F.lit(0).alias("m"), F.sum("n").alias("rest"), F.max("n").alias("next")).union(w)
    t = z.where(F.col("m") * share < 0.999).select("relation", "m", (F.col("rest") / (1 - F.col("m") * share)).alias("t"), "next")
    t = t.where(F.coalesce("next", F.lit(0)) <= share * F.col("t") + 1e-9).groupBy("relation").agg(F.min(F.struct("m", "t")).alias("x"))
    return t.select("relation", F.col("x.m").cast("bigint").alias("n_capped"), F.round("x.t", 4).alias("total"), F.floor(share * F.col("x.t") + 1e-6).alias("cap"))


@query("d11_two_strata", "flat", sql="""with s as (select row_id, language, case when contains(lower(answer_text), lower(option_a)) then 'near' else 'far' end as stratum from flat where answer_text is not null and option_a is not null)
 select row_id, language, stratum from (select *, row_number() over (partition by language, stratum order by md5(row_id || '|42'), row_id) as r from s) where r <= 20""")
def two_strata(flat):
    near = F.when(F.contains(F.lower("answer_text"), F.lower("option_a")), "near").otherwise("far")
    s = flat.where("answer_text is not null and option_a is not null").select("row_id", "language", near.alias("stratum"))
    return S.per_stratum(s, ["language", "stratum"], "row_id", 20)


@query("d13_style_anchors", "flat", sql="""select row_id, language, relation from (select row_id, language, relation, row_number() over (partition by language, relation order by md5(row_id || '|42'), row_id) as r from flat where question_verified and question is not null) where r <= 3""")
def style_anchors(flat):
    return S.per_stratum(flat.where("question_verified and question is not null").select("row_id", "language", "relation"), ["language", "relation"], "row_id", 3)


@query("d16_preference_instances", "flat", sql=f"""with r as (select fact_id, language, ids, gold, row_number() over (partition by fact_id order by md5(fact_id || '|' || language), language) as k from {FIRST} where gold is not null and ids is not null)
 select a.fact_id, a.language as lang_a, b.language as lang_b, a.gold as chosen, list_filter(a.ids, lambda x: x <> a.gold)[1] as rejected, list_position(b.ids, list_filter(a.ids, lambda x: x <> a.gold)[1]) - 1 as rejected_at from r a join r b on a.fact_id = b.fact_id and a.k = 1 and b.k = 2""")
def preference_instances(flat):
    """Two languages of a fact by hash, the gold entity as chosen, the first other as rejected, and where the second language has it."""
    p = predictions(flat).where("gold is not null and ids is not null").select("fact_id", F.struct(F.md5(F.concat_ws("|", "fact_id", "language")).alias("h"), "language", "ids", "gold").alias("s"))
    x = p.groupBy("fact_id").agg(F.array_sort(F.collect_list("s")).alias("s")).where("size(s) >= 2")  # twelve languages
    x = x.select("fact_id", F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).withColumn("rejected", F.get(F.filter("a.ids", lambda e: e != F.col("a.gold")), F.lit(0)))
    return x.select("fact_id", F.col("a.language").alias("lang_a"), F.col("b.language").alias("lang_b"), F.col("a.gold").alias("chosen"), "rejected", (F.nullif(F.array_position("b.ids", F.col("rejected")), F.lit(0)) - 1).alias("rejected_at"))
