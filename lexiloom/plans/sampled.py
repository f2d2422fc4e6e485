"""Sampling, metrics, nested structures and streams over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.stats import dot, uniform
from lexiloom.operators import metrics as M
from lexiloom.operators import sampling as S
from lexiloom.operators import windows as W
from lexiloom.operators.bootstrap import paired_bootstrap
from lexiloom.plans.registry import query



def rows_() -> Column:
    """The number of rows; made when asked for, as a module can be imported without a session."""
    return F.count(F.lit(1))
U = "(('0x' || substr(md5({}), 1, 8))::bigint + 0.5::double) / 4294967296::double"
#: Scores that stand in for a model's: four numbers that row and option decide.
SCORES = "[" + ", ".join(U.format(f"row_id || '|{i}'") for i in range(4)) + "]"
FIRST = "(select fact_id, language, arg_min(option_ids, row_id) as ids, min(row_id) as row_id, arg_min(option_ids[answer_index + 1], row_id) as gold from flat where fact_id is not null and answer_index is not null group by 1, 2)"
JUDGED = f"(select *, ids[list_position(scores, list_aggregate(scores, 'max'))] as pred, list_transform(list_sort(list_transform(list_zip(scores, ids), lambda p: {{'s': -p[1], 'e': p[2]}})), lambda p: p.e) as ranking from (select *, {SCORES} as scores from {FIRST}))"


def predictions(flat: DataFrame, *model: str) -> DataFrame:
    """The first row of each fact and language with scores of a stand-in model; further models are named."""
    gold = F.get("option_ids", F.col("answer_index").cast("int"))
    first = flat.where("fact_id is not null and answer_index is not null").groupBy("fact_id", "language").agg(F.min(F.struct("row_id", F.col("option_ids").alias("ids"), gold.alias("gold"))).alias("m")).select("fact_id", "language", "m.*")
    scores = F.array(*[uniform(F.col("row_id").cast("string"), F.lit(str(i)), *map(F.lit, model)) for i in range(4)])
    return M.judged(first.withColumn("scores", scores), "ids", "scores", "gold")


@query("d2_round_robin", "parallel", sql="select row_id, relation, round from (select row_id, relation, row_number() over (partition by relation order by md5(row_id || '|42'), row_id) as round from parallel where relation is not null) order by round, relation limit 300")
def round_robin(parallel):
    return S.round_robin(parallel.where("relation is not null").select("row_id", "relation"), "relation", "row_id", 300)


@query("d3_weighted_draw", "parallel", sql=f"""with w as (select relation, object_id, count(*) as n from parallel where relation is not null and object_id is not null group by 1, 2)
 select relation, object_id, draw from (select *, row_number() over (partition by relation order by -ln({U.format("object_id || '|42'")}) / n, object_id) as draw from w) where draw <= 3""")
def weighted_draw(parallel):
    w = parallel.where("relation is not null and object_id is not null").groupBy("relation", "object_id").agg(rows_().alias("n"))
    return S.weighted_draw(w, ["relation"], "object_id", "n", 3).select("relation", "object_id", "draw")


@query("d4_share_cap", "parallel", sql="""with c as (select relation, object_id, count(*) as n from parallel where relation is not null group by 1, 2), t as (select relation, sum(n) as total from c group by 1)
 select row_id from (select row_id, row_number() over (partition by p.relation, p.object_id order by md5(row_id || '|42'), row_id) as r, greatest(1, floor(0.2 * total)) as cap from parallel p join t on p.relation = t.relation) where r <= cap""")
def share_cap(parallel):
    t = parallel.where("relation is not null").groupBy("relation").agg(rows_().alias("total"))
    r = F.row_number().over(Window.partitionBy("relation", "object_id").orderBy(S.order_key("row_id", 42), "row_id"))
    x = parallel.select("row_id", "relation", "object_id").join(t, "relation").withColumn("r", r)
    return x.where(F.col("r") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("total")))).select("row_id")


@query("d5_option_shuffle", "flat", sql="""select row_id, x[1].o as first, list_position(list_transform(x, lambda p: p.o), option_a) - 1 as at from (select row_id, option_a, list_sort([{'h': md5(concat_ws('|', fact_id, language, option_a, '7')), 'o': option_a}, {'h': md5(concat_ws('|', fact_id, language, option_b, '7')), 'o': option_b}, {'h': md5(concat_ws('|', fact_id, language, option_c, '7')), 'o': option_c}, {'h': md5(concat_ws('|', fact_id, language, option_d, '7')), 'o': option_d}]) as x
 from flat where fact_id is not null and option_a is not null and option_b is not null and option_c is not null and option_d is not null)""")
def option_shuffle(flat):
    o = [f"option_{x}" for x in "abcd"]
    rows = flat.na.drop(subset=["fact_id", *o])
    x = S.shuffled_options(F.col("fact_id"), F.col("language"), [F.col(c) for c in o])
    return rows.select("row_id", "option_a", x.alias("x")).select("row_id", F.col("x")[0].alias("first"), (F.array_position("x", F.col("option_a")) - 1).alias("at"))


@query("d6_largest_remainder", "parallel", sql="""with c as (select coalesce(relation, '') as relation, count(*) as n from parallel group by 1), e as (select relation, n, n * 200.0::double / sum(n) over () as x from c), f as (select *, floor(x) as fl, round(x - floor(x), 9) as rest from e)
 select relation, (fl + case when row_number() over (order by rest desc, relation) <= 200 - sum(fl) over () then 1 else 0 end)::bigint as quota from f""")
def largest_remainder(parallel):
    c = parallel.groupBy(F.coalesce("relation", F.lit("")).alias("relation")).agg(rows_().alias("n"))
    return S.largest_remainder(c, "n", "relation", 200).select("relation", "quota")


@query("d7_stratified", "documents", sql="select doc_id from (select doc_id, row_number() over (partition by source order by md5(doc_id || '|42'), doc_id) as r from documents) where r <= 2")
def stratified(documents):
    return S.per_stratum(documents.select("doc_id", "source"), ["source"], "doc_id", 2).select("doc_id")


@query("d9_ratio_split", "documents", sql="select doc_id, case when r <= greatest(1, floor(n * 0.1)) then 'validation' else 'train' end as part from (select doc_id, row_number() over (partition by source order by md5(doc_id || '|42'), doc_id) as r, count(*) over (partition by source) as n from documents)")
def ratio_split(documents):
    n = documents.groupBy(F.col("source").alias("s")).agg(rows_().alias("n"))
    rows = documents.select("doc_id", "source", S.order_key("doc_id", 42).alias("h"))
    x = W.in_order(rows, ["source"], ["h", "doc_id"], W.hash_slices(F.col("h"))).join(n, F.col("source").eqNullSafe(F.col("s")))
    return x.select("doc_id", F.when(F.col("_nth") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), "validation").otherwise("train").alias("part"))


@query("d14_shards", "documents", sql="select doc_id, floor((row_number() over (order by doc_id) - 1) / ceil(count(*) over () / 8.0))::bigint as shard from documents")
def shards(documents):
    """Eight contiguous shards by id, all but the last of the same size."""
    n = documents.count()
    x = W.in_order(documents.select("doc_id"), [], ["doc_id"], W.range_slices(documents, "doc_id"))
    return x.select("doc_id", F.floor((F.col("_nth") - 1) / max(1, -(-n // 8))).alias("shard"))


@query("o11_length_batches", "documents", sql="select doc_id, (row_number() over (order by length(text), doc_id) - 1) // 32 as batch from documents where text is not null")
def length_batches(documents):
    """Batches of 32 texts of like length; results are keyed by id, so the order costs nothing."""
    x = documents.where("text is not null").select("doc_id", F.length("text").alias("n"))
    return W.in_order(x, [], ["n", "doc_id"], W.range_slices(x, "n")).select("doc_id", F.floor((F.col("_nth") - 1) / 32).alias("batch"))


@query("d10_simple_sample", "documents", sql="select doc_id from documents order by md5(doc_id || '|7'), doc_id limit 100")
def simple_sample(documents):
    return documents.select("doc_id").orderBy(S.order_key("doc_id", 7), "doc_id").limit(100)


@query("d12_exemplars", "flat", sql="select language, relation, list(row_id order by r)::varchar as rows from (select language, relation, row_id, row_number() over (partition by language, relation order by md5(row_id || '|42'), row_id) as r from flat where question_verified and relation is not null) where r <= 3 group by 1, 2")
def exemplars(flat):
    x = S.per_stratum(flat.where("question_verified and relation is not null").select("language", "relation", "row_id"), ["language", "relation"], "row_id", 3)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(S.order_key("row_id", 42).alias("h"), "row_id"))), lambda p: p["row_id"].cast("string"))
    return x.groupBy("language", "relation").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("rows"))


@query("d15_bootstrap", "flat", sql=f"""with v as (select language, row_id, (answer_index = 0)::int as x from flat where language in ('en', 'de') and answer_index is not null), b as (select language, b, x, {U.format("row_id || '|' || b || '|1'")} as u from v, range(0, 20) t(b)),
 w as (select language, b, x, (u > 0.36787944117144233)::int + (u > 0.7357588823428847)::int + (u > 0.9196986029286058)::int + (u > 0.9810118431238462)::int + (u > 0.9963401531726563)::int + (u > 0.9994058151824183)::int as w from b)
 select language, b, round(sum(w * x)::double / sum(w), 6) as mean from w group by 1, 2""")
def bootstrap(flat):
    v = flat.where("language in ('en', 'de') and answer_index is not null").select("language", "row_id", (F.col("answer_index") == 0).cast("int").alias("x"))
    return S.bootstrap_means(v, "row_id", "x", "language", 20).select("language", "b", F.round("mean", 6).alias("mean"))


@query("d15_bootstrap_paired", "flat")
def bootstrap_paired(flat):
    """Means and paired differences of all languages, facts as units, 10,000 draws; d15_bootstrap is the part that its SQL covers.

    Of a fact's rows in a language the first with an answer counts; rows without fact_id can't be paired.
    """
    v = flat.where("fact_id is not null and answer_index is not null").groupBy("fact_id", "language").agg(F.min_by((F.col("answer_index") == 0).cast("int"), "row_id").alias("x"))
    return paired_bootstrap(v, "fact_id", "x", "language").select(F.col("model_a").alias("lang_a"), F.col("model_b").alias("lang_b"), F.col("n").alias("n_facts"), *[F.round(c, 6).alias(c) for c in ("point", "low", "high", "p")])


@query("m20_significance", "flat")
def significance(flat):
    """Two models over the facts that both judged: accuracy, total consistency and agreement on one entity, with the
    difference, its 95 % interval and two-sided p from draws of facts that the models share (10,000)."""
    found = None
    for metric, of in (("accuracy", F.avg(F.col("correct").cast("int"))), ("all right", F.bool_and("correct").cast("int")), ("agreement", (F.countDistinct("pred") == 1).cast("int"))):
        runs = [predictions(flat, *m).where("gold is not null").groupBy("fact_id").agg(of.cast("double").alias("x")).withColumn("model", F.lit(name)) for name, m in (("base", ()), ("tuned", ("tuned",)))]
        b = paired_bootstrap(runs[0].union(runs[1]), "fact_id", "x", "model").select(F.lit(metric).alias("metric"), "model_a", "model_b", F.col("n").alias("n_facts"), *[F.round(c, 6).alias(c) for c in ("point", "low", "high", "p")])
        found = b if found is None else found.union(b)
    return found


@query("d17_coin_flip", "parallel", sql="select row_id, (('0x' || substr(md5(row_id || '|3'), 1, 8))::bigint % 2)::int as side from parallel")
def coin_flip(parallel):
    return parallel.select("row_id", (F.conv(F.substring(S.order_key("row_id", 3), 1, 8), 16, 10).cast("bigint") % 2).cast("int").alias("side"))


@query("x1_fan_out", "parallel", sql="select row_id, g from parallel, range(0, 4) t(g) where split = 'test'")
def fan_out(parallel):
    return parallel.where("split = 'test'").select("row_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))


@query("m1_score_modes", "flat", sql=f"select row_id, round(-100 * s / greatest(1, length(option_a)), 6) as per_char, round(-100 * s / greatest(1, strlen(option_a)), 6) as per_byte from (select row_id, option_a, {U.format('row_id::varchar')} as s from flat where option_a is not null)")
def score_modes(flat):
    x = flat.where("option_a is not null").select("row_id", "option_a", (uniform(F.col("row_id").cast("string")) * -100).alias("s"))
    return x.select("row_id", *[F.round(M.length_normalised(F.col("s"), F.lit(1), F.col("option_a"), m), 6).alias(f"per_{m}") for m in ("char", "byte")])


@query("m2_total_consistency", "flat", sql=f"select k, count(*) as n_facts from (select fact_id, count(*) filter (where pred = gold) as k, count(distinct language) as n from {JUDGED} group by 1) where n = 4 group by 1")
def total_consistency(flat):
    return M.consistency(predictions(flat), "fact_id", "language", 4)


#: The language lists that facts must be complete in: all twelve, as the reference has it, and those of j26_shared_ids.
LISTS = (("en", "de", "id", "pt", "ar", "bn", "sw", "es", "ru", "fr", "ja", "zh"), ("en", "de", "es", "fr"))


@query("m2_total_consistency_all", "flat")
def total_consistency_all(flat):
    """Facts complete in a stated list, other languages or none besides; m2_total_consistency and its SQL take facts with any four."""
    p = predictions(flat.where("option_ids is not null"))  # of a fact's rows in a language the first that can be judged
    of = [M.complete_consistency(p, "fact_id", "language", x).select(F.lit(",".join(x)).alias("languages"), "k", "n_facts") for x in LISTS]
    return of[0].union(of[1])


@query("m3_rank_consistency", "flat", sql=f"""with j as (select * from {JUDGED}) select a.language as lang_a, b.language as lang_b, round(avg((exp(3) * len(list_intersect(a.ranking[1:1], b.ranking[1:1])) + exp(2) * len(list_intersect(a.ranking[1:2], b.ranking[1:2])) / 2.0 + exp(1) * len(list_intersect(a.ranking[1:3], b.ranking[1:3])) / 3.0 + len(list_intersect(a.ranking, b.ranking)) / 4.0) / (exp(3) + exp(2) + exp(1) + 1)), 6) as rank_consistency,
 round(avg((a.pred = b.pred)::int), 6) as agreement, count(*) as n from j a join j b on a.fact_id = b.fact_id and a.language < b.language group by 1, 2""")
def ranks_by_pair(flat):
    p = M.pairwise(predictions(flat), "fact_id", "language")
    return p.select("lang_a", "lang_b", F.round("rank_consistency", 6).alias("rank_consistency"), F.round("agreement", 6).alias("agreement"), "n")


@query("m6_agreement_kinds", "flat", sql=f"select case when c then 'all correct' when d = 1 then 'agree wrong' else 'disagree' end as kind, count(*) as n_facts from (select fact_id, bool_and(pred = gold) as c, count(distinct pred) as d from {JUDGED} group by 1) group by 1")
def agreement_kinds(flat):
    return M.agreement_kinds(predictions(flat), "fact_id")


@query("m8_rewards", "flat", sql=f"select fact_id, round(sum(case when pred = gold then 1.0::double else -0.5::double end), 6) as reward, round(pow(avg((pred = gold)::int), 2), 6) as bonus from {JUDGED} group by 1")
def rewards(flat):
    x = predictions(flat).groupBy("fact_id").agg(F.sum(F.when(F.col("correct"), 1.0).otherwise(-0.5)).alias("r"), F.count_if("correct").alias("k"), rows_().alias("n"))
    return x.select("fact_id", F.round("r", 6).alias("reward"), F.round(M.bonus(F.col("k"), F.col("n"), "power"), 6).alias("bonus"))


@query("m10_advantages", "flat", sql=f"select fact_id, language, round((r - avg(r) over w) / (stddev_pop(r) over w + 1e-6), 4) + 0.0 as advantage from (select fact_id, language, case when pred = gold then 1.0::double else -0.5 end as r from {JUDGED}) window w as (partition by fact_id)")
def advantages(flat):
    w = Window.partitionBy("fact_id")
    r = F.when(F.col("correct"), 1.0).otherwise(-0.5)
    x = predictions(flat).select("fact_id", "language", r.alias("r"))
    return x.select("fact_id", "language", (F.round((F.col("r") - F.avg("r").over(w)) / (F.stddev_pop("r").over(w) + 1e-6), 4) + 0.0).alias("advantage"))


@query("m12_preference_pair", "embeddings", sql="""with e as (select label, vec_id, embedding::double[] as v from embeddings), s as (select a.label, a.vec_id, avg(round(list_dot_product(a.v, b.v), 6)) as m from e a join e b on a.label = b.label and a.vec_id <> b.vec_id group by 1, 2) select label, arg_max(vec_id, (round(m, 5), -vec_id)) as chosen, arg_min(vec_id, (round(m, 5), vec_id)) as rejected from s group by 1""")
def preference_pair(embeddings):
    """Mean similarity to the rest of the group, from the group's sum: no pairs are formed."""
    x = embeddings.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    cells = x.select("label", F.posexplode("v").alias("i", "c")).groupBy("label", "i").agg(F.sum("c").alias("c"))
    total = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("total"))
    n = x.groupBy("label").agg(rows_().alias("n"))
    m = x.join(total, "label").join(n, "label").where("n > 1").select("label", "vec_id", F.round((dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / (F.col("n") - 1), 5).alias("m"))
    return m.groupBy("label").agg(F.max_by("vec_id", F.struct("m", -F.col("vec_id"))).alias("chosen"), F.min_by("vec_id", F.struct("m", "vec_id")).alias("rejected"))


@query("m13_entropy", "events", sql="""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), p as (select *, n::double / sum(n) over (partition by user_id) as p from c) select user_id, round(-sum(p * ln(p + 1e-9)), 6) as entropy, arg_max(event_type, (p, event_type)) as dominant from p group by 1""")
def unit_entropy(events):
    c = events.groupBy("user_id", "event_type").agg(rows_().alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))  # a row an event type
    return p.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-9)), 6).alias("entropy"), F.max_by("event_type", F.struct("p", "event_type")).alias("dominant"))


@query("m14_top_overlap", "flat", sql="""with t as (select language, o, row_number() over (partition by language order by count(*) desc, o) as r from (select language, option_ids[1] as o from flat) group by 1, 2), k as (select language, o from t where r <= 50)
 select a.language as lang_a, b.language as lang_b, count(*) * 2.0::double as pct from k a join k b on a.o = b.o and a.language < b.language group by 1, 2""")
def top_overlap(flat):
    n = flat.groupBy("language", F.get("option_ids", F.lit(0)).alias("o")).agg(rows_().alias("n"))
    k = n.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "o"))).where("r <= 50")
    b = k.select("o", F.col("language").alias("lang_b"))
    return k.select("o", F.col("language").alias("lang_a")).join(b, "o").where("lang_a < lang_b").groupBy("lang_a", "lang_b").agg((rows_() * 2.0).alias("pct"))


@query("m18_weighted_loss", "lineitem", sql="select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) as perplexity from lineitem group by 1")
def weighted_loss(lineitem):
    loss = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")
    return lineitem.groupBy("l_returnflag").agg(F.round(loss, 6).alias("loss"), F.round(F.exp(loss), 6).alias("perplexity"))


@query("n1_unpivot", "parallel", sql="select row_id, lang, t.question as question, t.answer_index as answer_index from (select row_id, unnest(map_keys(translations)) as lang, unnest(map_values(translations)) as t from parallel)")
def unpivot(parallel):
    return parallel.select("row_id", F.explode("translations").alias("lang", "t")).select("row_id", "lang", "t.question", "t.answer_index")


@query("n2_pivot", "flat", sql="select fact_id, max(answer_text) filter (where language = 'en') as en, max(answer_text) filter (where language = 'de') as de, count(distinct language) as n from flat where fact_id is not null group by 1")
def pivot(flat):
    per = flat.where("fact_id is not null").groupBy("fact_id", "language").agg(F.max("answer_text").alias("a"))
    m = per.groupBy("fact_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "a"))).alias("m"))
    return m.select("fact_id", F.col("m")["en"].alias("en"), F.col("m")["de"].alias("de"), F.size("m").cast("bigint").alias("n"))


@query("n4_nested_update", "parallel", sql="select row_id, lang, case when lang = 'en' then coalesce(t.question_verified, true) else t.question_verified end as verified from (select row_id, unnest(map_keys(translations)) as lang, unnest(map_values(translations)) as t from parallel)")
def nested_update(parallel):
    t = F.transform_values("translations", lambda k, v: F.when(k == "en", v.withField("question_verified", F.coalesce(v["question_verified"], F.lit(True)))).otherwise(v))
    return parallel.select("row_id", F.explode(t).alias("lang", "t")).select("row_id", "lang", F.col("t.question_verified").alias("verified"))


@query("n5_rerender", "flat", "entity_labels", sql="""with l as (select id, language, max(label) as label from (select id, unnest(map_keys(labels)) as language, unnest(map_values(labels)) as label from entity_labels) where label <> '' group by 1, 2),
 o as (select row_id, language, unnest(option_ids) as id, unnest(range(1, len(option_ids) + 1)) as i from flat) select row_id, string_agg(coalesce(label, '?'), ' | ' order by i) as options from o left join l using (id, language) group by 1""")
def rerender(flat, labels):
    said = labels.select("id", F.explode("labels").alias("language", "label")).where("label <> ''").groupBy("id", "language").agg(F.max("label").alias("label"))
    o = flat.select("row_id", "language", F.posexplode("option_ids").alias("i", "id")).join(said, ["id", "language"], "left")
    x = F.array_sort(F.collect_list(F.struct("i", F.coalesce("label", F.lit("?")).alias("label"))))
    return o.groupBy("row_id").agg(F.array_join(F.transform(x, lambda p: p["label"]), " | ").alias("options"))


@query("n6_canonical_map", "flat", sql="select fact_id, language, arg_max(answer_text, row_id) as label from flat where answer_text is not null group by 1, 2")
def canonical_map(flat):
    return flat.where("answer_text is not null").groupBy("fact_id", "language").agg(F.max_by("answer_text", "row_id").alias("label"))


@query("n7_languages", "parallel", sql="select distinct unnest(map_keys(translations)) as lang from parallel")
def languages(parallel):
    return parallel.select(F.explode(F.map_keys("translations")).alias("lang")).distinct()


@query("n9_integrity", "flat", sql="""select category, count(*) as n from (select unnest(list_filter([case when question is null then 'no question' end, case when answer_text is null then 'no answer' end, case when answer_index is null then 'no index' end, case when answer_index is not null and [option_a, option_b, option_c, option_d][answer_index + 1] is distinct from answer_text then 'answer off index' end, case when subject is null then 'no subject' end], lambda x: x is not null)) as category from flat) group by 1""")
def integrity(flat):
    o = F.array(*[f"option_{x}" for x in "abcd"])
    checks = {"no question": F.col("question").isNull(), "no answer": F.col("answer_text").isNull(), "no index": F.col("answer_index").isNull(), "answer off index": F.col("answer_index").isNotNull() & ~F.get(o, F.col("answer_index").cast("int")).eqNullSafe(F.col("answer_text")), "no subject": F.col("subject").isNull()}
    found = F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))
    return flat.select(F.explode(found).alias("category")).groupBy("category").agg(rows_().alias("n"))


@query("n11_flags", "flat", sql="select row_id, case when question_verified and question_regenerated then null else question_verified end as flag from flat")
def flags(flat):
    return flat.select("row_id", F.when(F.col("question_verified") & F.col("question_regenerated"), F.lit(None)).otherwise(F.col("question_verified")).alias("flag"))


@query("e_tumbling_window", "events", sql="select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling(events):
    from lexiloom.streaming.events import tumbling_counts

    return tumbling_counts(events, "1 hour")


@query("d8_balanced_validation", "documents", sql="""with r as (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id || '|42'), doc_id) as r, count(*) over (partition by lang) as n from documents where lang is not null) select doc_id, lang from r where r <= least(10, n - 1)""")
def balanced_validation(documents):
    """Up to ten documents of each language for validation, at least one left for training."""
    x = documents.where("lang is not null").select("doc_id", "lang")
    n = x.groupBy("lang").agg(rows_().alias("n"))
    return S.per_stratum(x, ["lang"], "doc_id", 11).join(n, "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(S.order_key("doc_id", 42), "doc_id"))).where(F.col("r") <= F.least(F.lit(10), F.col("n") - 1)).select("doc_id", "lang")


@query("w11_sampler_keys", "flat", sql="select md5(fact_id || '|3') as block, rep, language, row_id from flat, range(0, 2) t(rep) where fact_id is not null and split = 'test'")
def sampler_keys(flat):
    """Sort keys (block, rep, language, row_id) of a sampler that permutes facts, keeps a fact's rows together and repeats each block."""
    rows = flat.where("fact_id is not null and split = 'test'")
    return rows.select(S.order_key("fact_id", 3).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("rep"), "language", "row_id")


@query("m15_delta_to_base", "flat", sql=f"with a as (select language, avg((pred = gold)::int) as acc from {JUDGED} group by 1) select language, round(acc - (select acc from a where language = 'en'), 6) + 0.0 as delta, round(100 * (acc / (select acc from a where language = 'en') - 1), 4) + 0.0 as pct from a")
def delta_to_base(flat):
    a = predictions(flat).groupBy("language").agg(F.avg(F.col("correct").cast("int")).alias("acc"))  # a row a language
    base = a.where("language = 'en'").select(F.col("acc").alias("base"))
    x = a.join(F.broadcast(base))
    return x.select("language", (F.round(F.col("acc") - F.col("base"), 6) + 0.0).alias("delta"), (F.round(100 * (F.col("acc") / F.col("base") - 1), 4) + 0.0).alias("pct"))
