"""Joins, aggregations, set operations, sorts and windows over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.stats import dot, wilson
from lexiloom.operators import windows as W
from lexiloom.plans.cleaning import NORM
from lexiloom.plans.registry import query
from lexiloom.plans.session import looked_up



def rows_() -> Column:
    """The number of rows; made when asked for, as a module can be imported without a session."""
    return F.count(F.lit(1))

# Joins


@query("j1_triples_labels", "parallel", "entity_labels", sql="""with l as (select id, max(labels['en']) as label from entity_labels group by 1)
 select row_id, p.label as property_label, o.label as object_label from parallel join l p on property_id = p.id join l o on object_id = o.id""")
def triples_labels(parallel, labels):
    en = labels.groupBy("id").agg(F.max(F.col("labels")["en"]).alias("label"))
    p, o = en.select(F.col("id").alias("property_id"), F.col("label").alias("property_label")), en.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"))
    return parallel.select("row_id", "property_id", "object_id").join(p, "property_id").join(o, "object_id").select("row_id", "property_label", "object_label")


@query("j2_typed_candidates", "parallel", "entity_types", "entity_labels", sql="""with o as (select distinct property_id, object_id from parallel where property_id is not null and object_id is not null),
 t as (select distinct id, unnest(types) as type from entity_types), l as (select id, max(labels['en']) as label from entity_labels group by 1),
 x as (select property_id, object_id, type, label from o join t on o.object_id = t.id join l on l.id = o.object_id where label is not null)
 select a.property_id, a.object_id, count(distinct b.object_id) as n from x a join x b on a.property_id = b.property_id and a.type = b.type and a.object_id <> b.object_id and abs(length(a.label) - length(b.label)) <= 15 group by 1, 2""")
def typed_candidates(parallel, entity_types, labels):
    """Other objects of a property that share a type and whose label is at most 15 characters longer or shorter.

    Objects are counted per (property, set of types, length) first, and only these cells are paired, so the pairs
    don't grow with the objects.
    """
    o = parallel.select("property_id", "object_id").where("property_id is not null and object_id is not null").distinct()
    t = entity_types.select(F.col("id").alias("object_id"), F.explode("types").alias("type")).groupBy("object_id").agg(F.array_sort(F.collect_set("type")).alias("types"))  # an object's types
    en = labels.groupBy(F.col("id").alias("object_id")).agg(F.max(F.col("labels")["en"]).alias("label")).where("label is not null")
    x = o.join(t, "object_id").join(en, "object_id").select("property_id", "object_id", "types", F.length("label").alias("n"))
    cells = x.groupBy("property_id", "types", "n").agg(rows_().alias("c"))
    a = cells.select("property_id", "types", "n", F.explode("types").alias("type"))
    b = cells.select("property_id", F.col("types").alias("others"), F.col("n").alias("m"), "c", F.explode("types").alias("type"))
    met = a.join(b, ["property_id", "type"]).where(F.abs(F.col("n") - F.col("m")) <= 15).drop("type").distinct()
    n = met.groupBy("property_id", "types", "n").agg((F.sum("c") - 1).alias("k")).where("k > 0")  # less the object itself
    return x.join(n, ["property_id", "types", "n"]).select("property_id", "object_id", F.col("k").alias("n"))


@query("j5_drop_ids", "flat", sql="select row_id from flat where fact_id is null or fact_id not in (select fact_id from flat where question is null and fact_id is not null)")
def drop_ids(flat):
    return flat.join(flat.where("question is null and fact_id is not null").select("fact_id").distinct(), "fact_id", "left_anti").select("row_id")


@query("j7_split_overlap", "parallel", sql="""select a.split as split_a, b.split as split_b, count(*) as n from (select distinct split, fact_id from parallel) a join (select distinct split, fact_id from parallel) b on a.fact_id = b.fact_id and a.split < b.split group by 1, 2""")
def split_overlap(parallel):
    s = parallel.select("split", "fact_id").where("fact_id is not null").distinct()
    per = s.groupBy("fact_id").agg(F.array_sort(F.collect_set("split")).alias("in")).where("size(in) > 1")  # three splits
    a = per.select("fact_id", F.posexplode("in").alias("i", "split_a"), "in")
    return a.select("split_a", F.explode(F.expr("slice(in, i + 2, 10)")).alias("split_b")).groupBy("split_a", "split_b").agg(rows_().alias("n"))


@query("j8_flat_parallel", "flat", "parallel", sql="""with p as (select fact_id, max(n_langs_verified) as n, min(subject) as subject from parallel where fact_id is not null group by 1), f as (select fact_id, max(n_langs_verified) as n, min(subject) as subject from flat where fact_id is not null group by 1)
 select count(*) filter (where p.fact_id is null) as only_flat, count(*) filter (where f.fact_id is null) as only_parallel, count(*) filter (where p.fact_id is not null and f.fact_id is not null and (p.n is distinct from f.n or p.subject is distinct from f.subject)) as differing from f full join p on f.fact_id = p.fact_id""")
def flat_parallel(flat, parallel):
    agg = lambda d, x: d.where("fact_id is not null").groupBy(F.col("fact_id").alias(f"fact_{x}")).agg(F.max("n_langs_verified").alias(f"n_{x}"), F.min("subject").alias(f"subject_{x}"))
    both = agg(flat, "f").join(agg(parallel, "p"), F.col("fact_f") == F.col("fact_p"), "full")
    differ = F.col("fact_f").isNotNull() & F.col("fact_p").isNotNull() & ~(F.col("n_f").eqNullSafe(F.col("n_p")) & F.col("subject_f").eqNullSafe(F.col("subject_p")))
    return both.agg(F.count_if(F.col("fact_p").isNull()).alias("only_flat"), F.count_if(F.col("fact_f").isNull()).alias("only_parallel"), F.count_if(differ).alias("differing"))


@query("j9_english_reference", "flat", sql="""with e as (select fact_id, min(answer_text) as en from flat where language = 'en' and fact_id is not null group by 1)
 select language, count(*) as n, count(*) filter (where answer_text = en) as same from flat join e using (fact_id) where language <> 'en' group by 1""")
def english_reference(flat):
    e = flat.where("language = 'en' and fact_id is not null").groupBy("fact_id").agg(F.min("answer_text").alias("en"))
    return flat.where("language <> 'en'").select("fact_id", "language", "answer_text").join(e, "fact_id").groupBy("language").agg(rows_().alias("n"), F.count_if(F.col("answer_text") == F.col("en")).alias("same"))


@query("j10_option_resolution", "flat", "entity_labels", sql="""with o as (select row_id, language, unnest([option_a, option_b, option_c, option_d]) as option from flat), l as (select distinct language, label from (select unnest(map_keys(labels)) as language, unnest(map_values(labels)) as label from entity_labels))
 select o.language, count(*) as n, count(l.label) as resolved from o left join l on o.language = l.language and o.option = l.label group by 1""")
def option_resolution(flat, labels):
    o = flat.select("language", F.explode(F.array(*[f"option_{x}" for x in "abcd"])).alias("option"))
    n = o.groupBy("language", "option").agg(rows_().alias("n"))  # combined first: a frequent option is one row
    said = labels.select(F.explode("labels").alias("language", "label")).distinct()
    hit = n.join(said, (n.language == said.language) & (n.option == said.label), "left").select(n.language, "n", "label")
    return hit.groupBy("language").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("resolved"))


@query("j11_option_alignment", "flat", sql="""with f as (select fact_id, language, min(row_id) as row_id from flat where fact_id is not null group by 1, 2), r as (select f.fact_id, f.language, option_ids from f join flat using (row_id)),
 e as (select fact_id, option_ids as ref from r where language = 'en') select r.fact_id, r.language, list_transform(ref, lambda x: list_position(option_ids, x) - 1)::varchar as slots from r join e using (fact_id) where list_sort(option_ids) = list_sort(ref)""")
def option_alignment(flat):
    first = flat.where("fact_id is not null").groupBy("fact_id", "language").agg(F.min_by("option_ids", "row_id").alias("option_ids"))
    e = first.where("language = 'en'").select("fact_id", F.col("option_ids").alias("ref"))
    both = first.join(e, "fact_id").where("array_sort(option_ids) = array_sort(ref)")
    slots = F.transform("ref", lambda x: F.array_position("option_ids", x) - 1)
    return both.select("fact_id", "language", F.concat(F.lit("["), F.array_join(slots.cast("array<string>"), ", "), F.lit("]")).alias("slots"))


@query("j15_benchmark_overlap", "parallel", "eval_items", sql=f"""with a as (select distinct {NORM.format('subject')} as s from parallel where subject is not null), b as (select distinct {NORM.format('option_a')} as s from eval_items)
 select (select count(*) from a) as n_ours, (select count(*) from b) as n_theirs, (select count(*) from a where s in (select s from b)) as shared""")
def benchmark_overlap(parallel, items):
    a = parallel.where("subject is not null").select(T.norm(F.col("subject")).alias("s"), F.lit(1).alias("w")).distinct()
    b = items.select(T.norm(F.col("option_a")).alias("s"), F.lit(2).alias("w")).distinct()
    w = a.union(b).groupBy("s").agg(F.sum("w").alias("w"))
    return w.agg(F.count_if(F.col("w").isin(1, 3)).alias("n_ours"), F.count_if(F.col("w") >= 2).alias("n_theirs"), F.count_if(F.col("w") == 3).alias("shared"))


@query("j17_phrase_join", "documents", "entity_labels", sql=rf"""with e as (select distinct id, {NORM.format("labels['en']")} as phrase from entity_labels where labels['en'] is not null), t as (select doc_id, string_split({NORM.format('text')}, ' ') as w from documents where lang = 'en' and text is not null),
 g as (select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select doc_id, w, unnest([1, 2, 3]) as n from t)))
 select id, count(distinct doc_id) as n_docs from g join e using (phrase) where length(phrase) >= 4 group by 1""")
def phrase_join(documents, labels):
    e = labels.select("id", T.norm(F.col("labels")["en"]).alias("phrase")).where("phrase is not null and length(phrase) >= 4").distinct()
    w = F.split(T.norm(F.col("text")), " ")
    g = documents.where("lang = 'en' and text is not null").select("doc_id", w.alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*[T.ngrams(F.col("w"), n) for n in (1, 2, 3)]))).alias("phrase"))
    g = looked_up(g, e.select("phrase").distinct(), ["phrase"], "left_semi")
    return g.join(e, "phrase").groupBy("id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("j17_phrase_join_all", "documents", "entity_labels")
def phrase_join_all(documents, labels):
    """Phrases of every word count that the labels have, in documents of any language; j17_phrase_join is the part that its SQL covers."""
    e = labels.select("id", T.norm(F.col("labels")["en"]).alias("phrase")).where("phrase is not null and length(phrase) >= 4").distinct()
    parts = e.withColumn("w", F.split("phrase", " "))
    longest = F.broadcast(parts.agg(F.max(F.size("w")).alias("longest")))
    heads = parts.groupBy(F.col("w")[0].alias("head")).agg(F.collect_set(F.size("w")).alias("sizes"))
    words = F.explode(F.array(F.split(T.norm(F.col("text")), " "))).alias("w")  # a generator's output isn't evaluated again
    at = F.transform("w", lambda x, i: F.struct(x.alias("head"), F.array_join(F.slice("w", i + 1, F.col("longest")), " ").alias("rest")))
    w = documents.where("text is not null").select("doc_id", words).join(longest).select("doc_id", F.inline(at))
    g = w.join(heads, "head").select("doc_id", "rest", F.explode("sizes").alias("n")).select("doc_id", F.call_function("substring_index", F.col("rest"), F.lit(" "), F.col("n")).alias("phrase"))
    return g.join(e, "phrase").groupBy("id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("j18_verbatim_reuse", "documents", "eval_items", sql=rf"""with b as (select distinct item_id, array_to_string(w[i:i + 7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as i from (select item_id, string_split({NORM.format('passage')}, ' ') as w from eval_items where lang not in ('ja', 'zh')))),
 d as (select distinct array_to_string(w[i:i + 7], ' ') as g from (select w, unnest(range(1, len(w) - 6)) as i from (select string_split({NORM.format('text')}, ' ') as w from documents where text is not null)))
 select count(distinct item_id) as n_items from b where g in (select g from d)""")
def verbatim_reuse(documents, items):
    words = lambda c: F.explode(F.array(F.split(T.norm(F.col(c)), " "))).alias("w")  # noqa: E731  (a generator's output isn't evaluated again)
    gram = F.explode(T.ngrams(F.col("w"), 8)).alias("g")
    b = items.where("lang not in ('ja', 'zh')").select("item_id", words("passage")).select("item_id", gram).distinct()
    d = documents.where("text is not null").select(words("text")).select(gram)
    hit = looked_up(d, b.select("g").distinct(), ["g"], "left_semi").distinct()  # the corpus' runs aren't shuffled
    return b.join(hit, "g").agg(F.countDistinct("item_id").alias("n_items"))


@query("j20_verdicts", "flat", sql="select language, coalesce(question_verified::varchar, 'unreviewed') as verdict, count(*) as n from flat group by 1, 2")
def verdicts(flat):
    return flat.groupBy("language", F.coalesce(F.col("question_verified").cast("string"), F.lit("unreviewed")).alias("verdict")).agg(rows_().alias("n"))


@query("j21_set_difference", "flat", "parallel", sql="""select (select count(*) from (select fact_id from flat except select fact_id from parallel)) as extra, (select count(*) from (select fact_id from parallel except select fact_id from flat)) as missing""")
def set_difference(flat, parallel):
    side = flat.select("fact_id", F.lit(1).alias("w")).distinct().union(parallel.select("fact_id", F.lit(2).alias("w")).distinct()).groupBy("fact_id").agg(F.sum("w").alias("w"))
    return side.agg(F.count_if(F.col("w") == 1).alias("extra"), F.count_if(F.col("w") == 2).alias("missing"))


@query("j22_manifest", "orders", "lineitem", sql="select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem) or o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) < 2)")
def manifest(orders, lineitem):
    n = lineitem.groupBy("l_orderkey").agg(rows_().alias("n"))
    return orders.join(n, orders.o_orderkey == n.l_orderkey, "left").where("n is null or n < 2").select("o_orderkey")


@query("j23_subsets", "parallel", "entity_redirects", sql="""select case when o.old_id is not null then 'stale' when n.new_id is not null then 'merged' else 'clean' end as subset, count(*) as n from parallel left join (select distinct old_id from entity_redirects) o on subject_id = o.old_id left join (select distinct new_id from entity_redirects) n on subject_id = n.new_id group by 1""")
def subsets(parallel, redirects):
    o, n = redirects.select("old_id").distinct(), redirects.select("new_id").distinct()
    x = parallel.select("subject_id").join(o, F.col("subject_id") == o.old_id, "left").join(n, F.col("subject_id") == n.new_id, "left")
    return x.groupBy(F.when(F.col("old_id").isNotNull(), "stale").when(F.col("new_id").isNotNull(), "merged").otherwise("clean").alias("subset")).agg(rows_().alias("n"))


@query("j26_shared_ids", "flat", sql="select fact_id from flat where language in ('en', 'de', 'es', 'fr') and fact_id is not null group by 1 having count(distinct language) = 4")
def shared_ids(flat):
    return flat.where(F.col("language").isin("en", "de", "es", "fr") & F.col("fact_id").isNotNull()).groupBy("fact_id").agg(F.countDistinct("language").alias("n")).where("n = 4").select("fact_id")


@query("j27_language_pairs", "flat", sql="""with r as (select distinct fact_id, language from flat where fact_id is not null) select a.language as lang_a, b.language as lang_b, count(*) as n from r a join r b on a.fact_id = b.fact_id and a.language < b.language group by 1, 2""")
def language_pairs(flat):
    per = flat.where("fact_id is not null").groupBy("fact_id").agg(F.array_sort(F.collect_set("language")).alias("langs"))  # twelve languages
    pairs = F.flatten(F.transform("langs", lambda a, i: F.transform(F.slice("langs", i + 2, 20), lambda b: F.struct(a.alias("lang_a"), b.alias("lang_b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.lang_a", "p.lang_b").agg(rows_().alias("n"))


@query("j29_nearest_neighbour", "embeddings", sql="""with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), c as (select vec_id as other, embedding::double[] as f from embeddings)
 select vec_id, arg_max(other, (sim, -other)) as nearest, max(sim) as sim from (select vec_id, other, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)), 6) as sim from q join c on vec_id <> other) group by 1""")
def nearest_neighbour(embeddings):
    """Every row whose id is divisible by 100 against all rows, in blocks of queries."""
    from lexiloom.operators.vectors import nearest

    return nearest(embeddings, embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding")


@query("j30_localised_label", "parallel", "entity_labels", sql="""with l as (select id, max(labels['sw']) as sw, max(labels['en']) as en from entity_labels group by 1) select row_id, coalesce(nullif(sw, ''), nullif(en, ''), object) as label from parallel left join l on object_id = id""")
def localised_label(parallel, labels):
    said = labels.groupBy("id").agg(F.max(F.col("labels")["sw"]).alias("sw"), F.max(F.col("labels")["en"]).alias("en"))
    return parallel.join(said, parallel.object_id == said.id, "left").select("row_id", F.coalesce(F.nullif("sw", F.lit("")), F.nullif("en", F.lit("")), "object").alias("label"))


# Aggregations


@query("a1_relation_counts", "parallel", sql="select relation, count(*) as n from parallel group by 1 order by n desc, relation")
def relation_counts(parallel):
    return parallel.groupBy("relation").agg(rows_().alias("n")).orderBy(F.desc("n"), "relation")


@query("a2_languages_per_fact", "flat", sql="select fact_id, count(distinct language) as n from flat group by 1 having count(distinct language) >= 3")
def languages_per_fact(flat):
    return flat.groupBy("fact_id").agg(F.countDistinct("language").alias("n")).where("n >= 3")


@query("a3_functional_dependency", "parallel", sql="select subject_id, property_id, count(distinct object_id) as n from parallel group by 1, 2 having count(distinct object_id) > 1")
def functional_dependency(parallel):
    return parallel.groupBy("subject_id", "property_id").agg(F.countDistinct("object_id").alias("n")).where("n > 1")


@query("a4_ambiguous_questions", "flat", sql="select language, question, count(distinct object) as n from flat where question is not null group by 1, 2 having count(distinct object) > 1")
def ambiguous_questions(flat):
    return flat.where("question is not null").groupBy("language", "question").agg(F.countDistinct("object").alias("n")).where("n > 1")


@query("a5_mode_label", "flat", sql="""with c as (select option_ids[2] as id, language, option_b as label, count(*) as n, min(row_id) as first from flat where option_b is not null group by 1, 2, 3)
 select id, language, label, n from (select *, row_number() over (partition by id, language order by n desc, first) as r from c) where r = 1""")
def mode_label(flat):
    c = flat.where("option_b is not null").groupBy(F.get("option_ids", F.lit(1)).alias("id"), "language", F.col("option_b").alias("label")).agg(rows_().alias("n"), F.min("row_id").alias("first"))
    return c.groupBy("id", "language").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "label")).alias("m")).select("id", "language", "m.label", "m.n")


@query("a6_label_variants", "flat", sql=f"""select id, language, count(distinct label) as n, count(distinct {NORM.format('label')}) as n_loose from (select option_ids[1] as id, language, option_a as label from flat where option_a is not null) group by 1, 2 having count(distinct label) > 1""")
def label_variants(flat):
    x = flat.where("option_a is not null").select(F.get("option_ids", F.lit(0)).alias("id"), "language", F.col("option_a").alias("label")).distinct()
    return x.groupBy("id", "language").agg(rows_().alias("n"), F.countDistinct(T.norm(F.col("label"))).alias("n_loose")).where("n > 1")


@query("a7_conditional_counts", "flat", sql="select language, count(*) as n, count(*) filter (where question is null) as no_question, count(*) filter (where answer_index is null) as no_index, count(*) filter (where question_verified) as verified, count(*) filter (where question_regenerated is null) as unclaimed from flat group by 1")
def conditional_counts(flat):
    return flat.groupBy("language").agg(rows_().alias("n"), F.count_if(F.col("question").isNull()).alias("no_question"), F.count_if(F.col("answer_index").isNull()).alias("no_index"), F.count_if("question_verified").alias("verified"), F.count_if(F.col("question_regenerated").isNull()).alias("unclaimed"))


@query("a8_position_histogram", "flat", sql="""select language, p0, p1, p2, p3, round(100.0 * (greatest(p0, p1, p2, p3) - least(p0, p1, p2, p3)) / (p0 + p1 + p2 + p3), 4) as range_pp from (select language, count(*) filter (where answer_index = 0) p0, count(*) filter (where answer_index = 1) p1, count(*) filter (where answer_index = 2) p2, count(*) filter (where answer_index = 3) p3 from flat group by 1)""")
def position_histogram(flat):
    p = [F.count_if(F.col("answer_index") == i).alias(f"p{i}") for i in range(4)]
    x = flat.groupBy("language").agg(*p)
    cols = [f"p{i}" for i in range(4)]
    return x.withColumn("range_pp", F.round(100.0 * (F.greatest(*cols) - F.least(*cols)) / (F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3")), 4))


@query("a9_k_of_n", "flat", sql="select k, count(*) as n_facts from (select fact_id, count(distinct language) filter (where question_verified) as k from flat where fact_id is not null group by 1) group by 1")
def k_of_n(flat):
    k = flat.where("fact_id is not null").groupBy("fact_id").agg(F.countDistinct(F.when(F.col("question_verified"), F.col("language"))).alias("k"))
    return k.groupBy("k").agg(rows_().alias("n_facts"))


@query("a10_rate_matrix", "flat", sql="""select relation, round(avg(v) filter (where language = 'en'), 6) as en, round(avg(v) filter (where language = 'de'), 6) as de, round(avg(v) filter (where language = 'ru'), 6) as ru, round(avg(v), 6) as mean from (select relation, language, question_verified::int as v from flat) group by 1""")
def rate_matrix(flat):
    v = F.col("question_verified").cast("int")
    return flat.groupBy("relation").agg(*[F.round(F.avg(F.when(F.col("language") == x, v)), 6).alias(x) for x in ("en", "de", "ru")], F.round(F.avg(v), 6).alias("mean"))


@query("a11_distractor_concentration", "flat", sql="""with d as (select relation, o as text, count(*) as n from (select relation, unnest([option_a, option_b, option_c, option_d]) as o, object from flat where language = 'en') where o is not null and o is distinct from object group by 1, 2)
 select relation, count(*) as n_distinct, max(n) as top1, (sum(n) filter (where r <= 10))::bigint as top10, sum(n)::bigint as total from (select *, row_number() over (partition by relation order by n desc, text) as r from d) group by 1""")
def distractor_concentration(flat):
    o = flat.where("language = 'en'").select("relation", "object", F.explode(F.array(*[f"option_{x}" for x in "abcd"])).alias("text")).where("text is not null and not (text <=> object)")
    d = o.groupBy("relation", "text").agg(rows_().alias("n"))
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("n"), "text")))
    return r.groupBy("relation").agg(rows_().alias("n_distinct"), F.max("n").alias("top1"), F.sum(F.when(F.col("r") <= 10, F.col("n"))).alias("top10"), F.sum("n").alias("total"))


@query("a12_off_pool", "flat", sql="""with g as (select distinct relation, object from flat where language = 'en'), d as (select row_id, relation, unnest([option_a, option_b, option_c, option_d]) as o from flat where language = 'en')
 select count(*) as n, count(*) filter (where not exists (select 1 from g where g.relation = d.relation and g.object = d.o)) as off_relation, count(*) filter (where not exists (select 1 from g where g.object = d.o)) as off_all from d where o is not null and relation is not null""")
def off_pool(flat):
    en = flat.where("language = 'en'")
    d = en.select("relation", F.explode(F.array(*[f"option_{x}" for x in "abcd"])).alias("o")).where("o is not null and relation is not null").groupBy("relation", "o").agg(rows_().alias("n"))
    g = en.select(F.col("relation").alias("gr"), F.col("object").alias("go")).distinct()
    h = g.select(F.col("go").alias("ho")).distinct()
    x = d.join(g, (d.relation == g.gr) & (d.o == g.go), "left").join(h, d.o == h.ho, "left")
    return x.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("go").isNull(), F.col("n")).otherwise(0)).alias("off_relation"), F.sum(F.when(F.col("ho").isNull(), F.col("n")).otherwise(0)).alias("off_all"))


_LENGTHS, _OPTIONS = "[length(option_a), length(option_b), length(option_c), length(option_d)]", "[option_a, option_b, option_c, option_d]"


@query("a13_heuristics", "flat", sql=f"""select language, round(avg((longest = answer_index)::int), 6) as longest, round(avg((shortest = answer_index)::int), 6) as shortest, round(avg((first_abc = answer_index)::int), 6) as alphabetical from (select language, answer_index,
 list_position({_LENGTHS}, list_max({_LENGTHS})) - 1 as longest, list_position({_LENGTHS}, list_min({_LENGTHS})) - 1 as shortest, list_position({_OPTIONS}, list_min({_OPTIONS})) - 1 as first_abc
 from flat where answer_index is not null and option_a is not null and option_b is not null and option_c is not null and option_d is not null) group by 1""")
def heuristics(flat):
    """How often the longest, the shortest and the alphabetically first option (by code point) is the answer; the most frequent gold is a14's."""
    o = [f"option_{x}" for x in "abcd"]
    rows = flat.where("answer_index is not null").na.drop(subset=o)
    n, t = F.array(*[F.length(x) for x in o]), F.array(*o)
    hit = lambda x, v: F.round(F.avg((F.array_position(x, v) - 1 == F.col("answer_index")).cast("int")), 6)
    return rows.groupBy("language").agg(hit(n, F.array_max(n)).alias("longest"), hit(n, F.array_min(n)).alias("shortest"), hit(t, F.array_min(t)).alias("alphabetical"))


@query("a14_frequency_prior", "flat", sql="""with t as (select object, count(*) as n from flat where language = 'en' and split = 'train' group by 1), o as (select row_id, split, object, unnest([option_a, option_b, option_c, option_d]) as opt from flat where language = 'en'),
 s as (select o.row_id, o.split, o.object, o.opt, coalesce(t.n, 0) - (case when o.split = 'train' and o.opt = o.object then 1 else 0 end) as n from o left join t on t.object = o.opt where opt is not null),
 b as (select row_id, split, object, arg_max(opt, (n, md5(opt))) as best from s group by 1, 2, 3) select split, count(*) as n_items, count(*) filter (where best = object) as n_hit from b group by 1""")
def frequency_prior(flat):
    en = flat.where("language = 'en'")
    t = en.where("split = 'train'").groupBy(F.col("object").alias("opt")).agg(rows_().alias("n"))
    o = en.select("row_id", "split", "object", F.explode(F.array(*[f"option_{x}" for x in "abcd"])).alias("opt")).where("opt is not null").join(t, "opt", "left")
    n = F.coalesce("n", F.lit(0)) - F.when((F.col("split") == "train") & (F.col("opt") == F.col("object")), 1).otherwise(0)
    b = o.groupBy("row_id", "split", "object").agg(F.max_by("opt", F.struct(n, F.md5("opt"))).alias("best"))
    return b.groupBy("split").agg(rows_().alias("n_items"), F.count_if(F.col("best") == F.col("object")).alias("n_hit"))


@query("a15_length_ratio", "flat", sql="with m as (select language, median(length(question)) as med from flat group by 1) select language, med, round(med / (select med from m where language = 'en'), 6) as ratio from m")
def length_ratio(flat):
    m = flat.groupBy("language").agg(F.percentile(F.length("question"), 0.5).alias("med"))
    en = m.where("language = 'en'").select(F.col("med").alias("en"))  # one row
    return m.join(F.broadcast(en)).select("language", "med", F.round(F.col("med") / F.col("en"), 6).alias("ratio"))


@query("a16_gold_lengths", "flat", sql=f"""with r as (select language, {_LENGTHS} as n, answer_index + 1 as g from flat where answer_index between 0 and 3 and option_a is not null and option_b is not null and option_c is not null and option_d is not null)
 select language, round(avg(n[g]), 6) as gold, round(avg((list_sum(n) - n[g]) / 3.0::double), 6) as distractors, count(*) filter (where n[g] = list_max(n)) as longest from r group by 1""")
def gold_lengths(flat):
    """Mean length of the gold option and of the three others, and how often no option is longer than the gold one."""
    o = [f"option_{x}" for x in "abcd"]
    r = flat.where("answer_index between 0 and 3").na.drop(subset=o).select("language", F.array(*[F.length(x) for x in o]).alias("n"), F.col("answer_index").cast("int").alias("g"))
    gold = F.get("n", "g")
    rest = F.aggregate("n", F.lit(0), lambda a, x: a + x) - gold
    return r.groupBy("language").agg(F.round(F.avg(gold), 6).alias("gold"), F.round(F.avg(rest / 3.0), 6).alias("distractors"), F.count_if(gold == F.array_max("n")).alias("longest"))


@query("a17_split_gap", "parallel", sql="""select relation, round(tr, 6) as train_share, round(te, 6) as test_share, round(abs(tr - te), 6) as gap from (select relation, count(*) filter (where split = 'train') * 1.0 / (select count(*) from parallel where split = 'train') as tr, count(*) filter (where split = 'test') * 1.0 / (select count(*) from parallel where split = 'test') as te from parallel group by 1)""")
def split_gap(parallel):
    n = parallel.groupBy("relation").agg(F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") == "test").alias("te"))
    t = n.agg(F.sum("tr").alias("all_tr"), F.sum("te").alias("all_te"))  # one row
    x = n.join(F.broadcast(t)).select("relation", (F.col("tr") / F.col("all_tr")).alias("tr"), (F.col("te") / F.col("all_te")).alias("te"))
    return x.select("relation", F.round("tr", 6).alias("train_share"), F.round("te", 6).alias("test_share"), F.round(F.abs(F.col("tr") - F.col("te")), 6).alias("gap"))


@query("a18_overlap_shares", "parallel", sql="""select field, count(*) filter (where in_train) as shared, count(*) as n_test from (select field, v, bool_or(split = 'train') as in_train, bool_or(split = 'test') as in_test from (select 'subject' as field, subject_id as v, split from parallel union all select 'object', object_id, split from parallel union all select 'property', property_id, split from parallel) where v is not null group by 1, 2) where in_test group by 1""")
def overlap_shares(parallel):
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"{k}_id").alias("v")) for k in ("subject", "object", "property")])).alias("c")
    x = parallel.select("split", v).select("split", "c.*").where("v is not null").groupBy("field", "v").agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") == "test").alias("in_test"))
    return x.where("in_test").groupBy("field").agg(F.count_if("in_train").alias("shared"), rows_().alias("n_test"))


@query("a21_verdict_rollup", "flat", sql="select language, count(*) filter (where question_verified) as ok, count(*) filter (where not question_verified) as defect, count(*) filter (where question_verified is null) as unreviewed from flat group by rollup (language)")
def verdict_rollup(flat):
    v = F.col("question_verified")
    return flat.rollup("language").agg(F.count_if(v).alias("ok"), F.count_if(~v).alias("defect"), F.count_if(v.isNull()).alias("unreviewed"))


@query("a22_wilson", "flat", sql="""with c as (select language, count(*) filter (where not question_verified) as k, count(question_verified) as n from flat group by 1) select language, k, n, round(greatest((k::double / n + 1.9207294103470803 / n - 1.959963984540054 * sqrt(k::double / n * (1 - k::double / n) / n + 3.8414588206941605 / (4.0 * n * n))) / (1 + 3.8414588206941605 / n), 0), 6) as low,
 round(least((k::double / n + 1.9207294103470803 / n + 1.959963984540054 * sqrt(k::double / n * (1 - k::double / n) / n + 3.8414588206941605 / (4.0 * n * n))) / (1 + 3.8414588206941605 / n), 1), 6) as high from c""")
def wilson_interval(flat):
    c = flat.groupBy("language").agg(F.count_if(~F.col("question_verified")).alias("k"), F.count("question_verified").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("language", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("a23_extrapolation", "flat", sql="with s as (select language, count(*) as size, avg((not question_verified)::int) as rate from flat group by 1) select round(sum(size * rate) / sum(size), 6) as rate, sum(size)::bigint as n from s")
def extrapolation(flat):
    s = flat.groupBy("language").agg(rows_().alias("size"), F.avg((~F.col("question_verified")).cast("int")).alias("rate"))
    return s.agg(F.round(F.sum(F.col("size") * F.col("rate")) / F.sum("size"), 6).alias("rate"), F.sum("size").alias("n"))


@query("a24_length_summary", "documents", sql="select lang, count(n) as n, min(n) as lo, round(avg(n), 4) as mean, round(quantile_cont(n, 0.5), 4) as p50, round(quantile_cont(n, 0.9), 4) as p90, round(quantile_cont(n, 0.95), 4) as p95, round(quantile_cont(n, 0.99), 4) as p99, max(n) as hi from (select lang, length(text) as n from documents) group by 1")
def length_summary(documents):
    n = F.length("text")
    p = F.percentile(n, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    x = documents.groupBy("lang").agg(F.count(n).alias("n"), F.min(n).alias("lo"), F.round(F.avg(n), 4).alias("mean"), p.alias("p"), F.max(n).alias("hi"))
    return x.select("lang", "n", "lo", "mean", *[F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(("p50", "p90", "p95", "p99"))], "hi")


@query("a25_thresholds", "flat", sql="select n_langs_verified, count(*) as n, count(*) filter (where length(question) > 50) as over_50, count(*) filter (where length(question) > 100) as over_100 from flat group by 1")
def thresholds(flat):
    return flat.groupBy("n_langs_verified").agg(rows_().alias("n"), *[F.count_if(F.length("question") > k).alias(f"over_{k}") for k in (50, 100)])


@query("a26_split_statistics", "flat", sql="select split, count(*) as n, sum(length(question) // 4)::bigint as tokens, round(avg(length(question) // 4), 6) as mean, min(length(question) // 4) as lo, max(length(question) // 4) as hi from flat group by 1")
def split_statistics(flat):
    t = T.estimated_tokens(F.col("question"))
    return flat.groupBy("split").agg(rows_().alias("n"), F.sum(t).alias("tokens"), F.round(F.avg(t), 6).alias("mean"), F.min(t).alias("lo"), F.max(t).alias("hi"))


@query("a29_macro_average", "flat", sql="""with a as (select language, avg((answer_index = 0)::int) as acc from flat group by 1) select case when language in ('en', 'de', 'es', 'fr', 'ru', 'zh', 'ja') then 'high' else 'low' end as tier, round(avg(acc), 6) as macro from a group by 1""")
def macro_average(flat):
    a = flat.groupBy("language").agg(F.avg((F.col("answer_index") == 0).cast("int")).alias("acc"))
    tier = F.when(F.col("language").isin("en", "de", "es", "fr", "ru", "zh", "ja"), "high").otherwise("low")
    return a.groupBy(tier.alias("tier")).agg(F.round(F.avg("acc"), 6).alias("macro"))


@query("a31_pivot_delta", "lineitem", sql="select l_returnflag, round(sum(l_quantity) filter (where l_linestatus = 'F'), 2) as f, round(sum(l_quantity) filter (where l_linestatus = 'O'), 2) as o, round(coalesce(sum(l_quantity) filter (where l_linestatus = 'F'), 0) - coalesce(sum(l_quantity) filter (where l_linestatus = 'O'), 0), 2) as delta from lineitem group by 1")
def pivot_delta(lineitem):
    x = lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return x.select("l_returnflag", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round(F.coalesce("F", F.lit(0)) - F.coalesce("O", F.lit(0)), 2).alias("delta"))


@query("a33_profile_distance", "lineitem", sql="""with m as (select l_returnflag as flag, month(l_shipdate) as m, count(*) as n from lineitem group by 1, 2), c as (select flag, m, sum(n) over (partition by flag order by m) * 1.0 / sum(n) over (partition by flag) as p from m)
 select a.flag, round(max(abs(a.p - b.p)), 6) as ks from c a join c b on a.m = b.m and b.flag = 'A' where a.flag <> 'A' group by 1""")
def profile_distance(lineitem):
    m = lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.month("l_shipdate").alias("m")).agg(rows_().alias("n"))  # months a flag
    w = Window.partitionBy("flag")
    c = m.select("flag", "m", (F.sum("n").over(w.orderBy("m")) / F.sum("n").over(w)).alias("p"))
    base = c.where("flag = 'A'").select("m", F.col("p").alias("q"))
    return c.where("flag <> 'A'").join(base, "m").groupBy("flag").agg(F.round(F.max(F.abs(F.col("p") - F.col("q"))), 6).alias("ks"))


@query("a34_max_record", "orders", sql="select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as best, max(o_totalprice) as price from orders group by 1")
def max_record(orders):
    return orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("price"))


_NULLABLE = ("row_id", "fact_id", "language", "subject", "relation", "object", "question", "option_a", "option_b", "answer_text", "answer_index", "question_verified", "split")


@query("a35_common_columns", "flat", sql=" union all ".join(f"select '{c}' as column_name from flat having count({c}) = count(*)" for c in _NULLABLE))
def common_columns(flat):
    """The columns that every row has a value in; counted in one pass."""
    n = flat.agg(rows_().alias("_all"), *[F.count(c).alias(c) for c in _NULLABLE])
    return n.select(F.explode(F.array_compact(F.array(*[F.when(F.col(c) == F.col("_all"), F.lit(c)) for c in _NULLABLE]))).alias("column_name"))


# Windows, sorts and sets


@query("w1_packing", "documents")
def packing(documents):
    return W.pack(documents, "source", "doc_id", "text", 1000)


@query("w3_budget", "documents", sql="select doc_id from (select doc_id, sum(length(text) // 4) over (partition by source order by doc_id rows unbounded preceding) - length(text) // 4 as before from documents where text is not null) where before < 2000")
def budget(documents):
    x = documents.where("text is not null").select("doc_id", "source", T.estimated_tokens(F.col("text")).alias("n"))
    return W.budget_cut(x, ["source"], ["doc_id"], "n", 2000, W.range_slices(documents, "doc_id")).select("doc_id")


@query("w4_first_occurrence", "flat", sql="select row_id from (select row_id, row_number() over (partition by fact_id, language order by row_id) as r from flat) where r = 1")
def first_occurrence(flat):
    return W.first_occurrence(flat.select("row_id", "fact_id", "language"), ["fact_id", "language"], ["row_id"]).select("row_id")


@query("w5_full_parts", "documents", sql="select source, part, count(*) as n from (select source, (row_number() over (partition by source order by doc_id) - 1) // 4 as part from documents) group by 1, 2 having count(*) = 4")
def full_parts(documents):
    return W.parts(documents.select("source", "doc_id"), ["source"], ["doc_id"], 4, False, W.range_slices(documents, "doc_id")).groupBy("source", "part").agg(rows_().alias("n"))


@query("w6_all_parts", "documents", sql="select source, part, count(*) as n from (select source, (row_number() over (partition by source order by doc_id) - 1) // 4 as part from documents) group by 1, 2")
def all_parts(documents):
    return W.parts(documents.select("source", "doc_id"), ["source"], ["doc_id"], 4, True, W.range_slices(documents, "doc_id")).groupBy("source", "part").agg(rows_().alias("n"))


@query("w7_cumulative", "lineitem", sql="select flag, m, (sum(q) over (partition by flag order by m))::bigint as upto from (select l_returnflag as flag, strftime(l_shipdate, '%Y-%m') as m, count(*) as q from lineitem group by 1, 2)")
def cumulative(lineitem):
    q = lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(rows_().alias("q"))
    return q.select("flag", "m", F.sum("q").over(Window.partitionBy("flag").orderBy("m")).alias("upto"))


@query("w8_best_second", "parallel", sql="select source, relation, n, r from (select source, relation, count(*) as n, row_number() over (partition by source order by count(*) desc, relation) as r from parallel where relation is not null group by 1, 2) where r <= 2")
def best_second(parallel):
    n = parallel.where("relation is not null").groupBy("source", "relation").agg(rows_().alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "relation"))).where("r <= 2")


@query("w9_runs", "events", sql="""select user_id, run, count(*) as n from (select user_id, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as run, event_type from events) group by user_id, event_type, run""")
def runs(events):
    a, b = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    x = events.select("user_id", "event_type", (F.row_number().over(a) - F.row_number().over(b)).alias("run"))
    return x.groupBy("user_id", "event_type", "run").agg(rows_().alias("n")).select("user_id", "run", "n")


@query("w10_zscore", "lineitem", sql="select l_orderkey, l_linenumber, round((l_extendedprice - avg(l_extendedprice) over w) / (stddev_pop(l_extendedprice) over w + 1e-6), 3) + 0.0 as z from lineitem window w as (partition by l_orderkey)")
def zscore(lineitem):
    return W.zscores(lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", (F.round("z", 3) + 0.0).alias("z"))


@query("o1_sorted_limit", "orders", sql="select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def sorted_limit(orders):
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("o4_top_share", "embeddings", sql="with u as (select label, i, abs(embedding[i]) as v from embeddings, range(1, 65) t(i)) select label, i from (select label, i, row_number() over (partition by label order by max(v) desc, i) as r from u group by 1, 2) where r <= 6")
def top_share(embeddings):
    u = embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", (F.col("i") + 1).alias("i")).agg(F.max(F.abs("v")).alias("v"))
    return u.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "i"))).where("r <= 6").select("label", "i")


@query("o6_quantile_select", "parallel", sql="""with c as (select source, relation, count(*) as n from parallel where relation is not null group by 1, 2), q as (select source, quantile_cont(n, 0.8) as t from c group by 1), s as (select source, relation from c join q using (source) where n >= t) select source, relation from s where relation not in (select relation from s group by 1 having count(*) >= 6)""")
def quantile_select(parallel):
    c = parallel.where("relation is not null").groupBy("source", "relation").agg(rows_().alias("n"))
    q = c.groupBy("source").agg(F.percentile("n", 0.8).alias("t"))
    s = c.join(q, "source").where("n >= t").select("source", "relation")
    return s.join(s.groupBy("relation").agg(rows_().alias("k")).where("k >= 6"), "relation", "left_anti").select("source", "relation")


@query("o7_most_common", "parallel", sql="select object, count(*) as n from parallel where object is not null group by 1 order by n desc, object limit 20")
def most_common(parallel):
    return parallel.where("object is not null").groupBy("object").agg(rows_().alias("n")).orderBy(F.desc("n"), "object").limit(20)


@query("o10_examples", "flat", sql="select language, row_id from (select language, row_id, row_number() over (partition by language order by row_id) as r from flat where question is null) where r <= 3")
def examples(flat):
    return flat.where("question is null").withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy("row_id"))).where("r <= 3").select("language", "row_id")


@query("u1_union", "flat", "parallel", sql="select subject, 'flat' as source_table from flat union all select subject, 'parallel' from parallel")
def union(flat, parallel):
    return flat.select("subject", F.lit("flat").alias("source_table")).unionByName(parallel.select("subject", F.lit("parallel").alias("source_table")))


@query("u3_defect_union", "flat", sql="select row_id from flat where question is null union select row_id from flat where answer_text is null union select row_id from flat where answer_index is null")
def defect_union(flat):
    return flat.where("question is null or answer_text is null or answer_index is null").select("row_id").distinct()


@query("u4_intersection", "parallel", sql="select subject_id from parallel where split = 'train' intersect select subject_id from parallel where split = 'test'")
def intersection(parallel):
    return parallel.where("split = 'train'").select("subject_id").intersect(parallel.where("split = 'test'").select("subject_id"))


@query("u5_difference", "parallel", sql="select subject_id from parallel where split = 'test' except select subject_id from parallel where split = 'train'")
def difference(parallel):
    return parallel.where("split = 'test'").select("subject_id").subtract(parallel.where("split = 'train'").select("subject_id"))


@query("u8_duplicates", "flat", sql="select language, count(*) - count(distinct fact_id) as n_repeated from flat group by 1")
def duplicates(flat):
    return flat.groupBy("language").agg((rows_() - F.countDistinct("fact_id")).alias("n_repeated"))
