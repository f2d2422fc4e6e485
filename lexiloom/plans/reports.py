"""Metrics over supplied scores, report tables, evidence classes and validation of nested rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexiloom.functions import text as T
from lexiloom.functions.stats import entropy
from lexiloom.operators import metrics as M
from lexiloom.operators import windows as W
from lexiloom.plans.cleaning import NORM
from lexiloom.plans.registry import query
from lexiloom.plans.sampled import JUDGED, predictions, rows_

# Metrics

_HEADS = "(exp(3) * len(list_intersect(a.ranking[1:1], b.ranking[1:1])) + exp(2) * len(list_intersect(a.ranking[1:2], b.ranking[1:2])) / 2.0 + exp(1) * len(list_intersect(a.ranking[1:3], b.ranking[1:3])) / 3.0 + len(list_intersect(a.ranking, b.ranking)) / 4.0) / (exp(3) + exp(2) + exp(1) + 1)"


@query("m4_rank_report", "flat", sql=f"""with j as (select * from {JUDGED}), p as (select a.language as la, b.language as lb, avg({_HEADS}) as r from j a join j b on a.fact_id = b.fact_id and a.language < b.language group by 1, 2),
 c as (select (exp(3) / 4 + exp(2) * 2 / 4 + exp(1) * 3 / 4 + 1) / (exp(3) + exp(2) + exp(1) + 1) as chance, (exp(1) * 2 / 3 + 1) / (exp(3) + exp(2) + exp(1) + 1) as least)
 select round(avg(r), 6) as average, round(avg(r) filter (where la = 'en' or lb = 'en'), 6) as with_english, round(max(least), 6) as least, round(max(chance), 6) as chance, round((avg(r) - max(chance)) / (1 - max(chance)), 6) as rescaled from p, c""")
def rank_report(flat):
    """Rank consistency over all pairs and those with English, the least that four options allow, chance, and the
    average rescaled so that chance is 0."""
    p = M.pairwise(predictions(flat), "fact_id", "language")
    w = [F.exp(F.lit(float(4 - j))) for j in (1, 2, 3, 4)]
    total = sum(w[1:], w[0])
    chance = sum((w[j - 1] * j / 4 for j in (2, 3, 4)), w[0] / 4) / total
    least = sum((w[j - 1] * max(2 * j - 4, 0) / j for j in (2, 3, 4)), w[0] * 0) / total
    english = F.when((F.col("lang_a") == "en") | (F.col("lang_b") == "en"), F.col("rank_consistency"))
    a = p.agg(F.avg("rank_consistency").alias("r"), F.avg(english).alias("e"))
    return a.select(F.round("r", 6).alias("average"), F.round("e", 6).alias("with_english"), F.round(least, 6).alias("least"), F.round(chance, 6).alias("chance"), F.round((F.col("r") - chance) / (1 - chance), 6).alias("rescaled"))


_SAYS = "coalesce({g} <> '' and (p = {g} or contains(' ' || p || ' ', ' ' || {g} || ' ') or starts_with(p, {g})), false)"


@query("m7_free_form", "flat", sql=f"""with n as (select language, answer_index, {NORM.format('answer_text')} as p, {", ".join(f"{NORM.format(f'option_{c}')} as o{i}" for i, c in enumerate("abcd"))} from flat where answer_text is not null),
 r as (select language, answer_index, case {" ".join(f"when {_SAYS.format(g=f'o{i}')} then {i}" for i in range(4))} end as pick from n) select language, count(*) as n, count(pick) as n_resolved, count(*) filter (where pick = answer_index) as n_right from r group by 1""")
def free_form(flat):
    """Free answers resolved to the first option that they state: how many can be, and how many are the gold one."""
    pick = F.coalesce(*[F.when(T.is_correct(F.col("answer_text"), F.col(f"option_{c}")), i) for i, c in enumerate("abcd")])
    r = flat.where("answer_text is not null").select("language", "answer_index", pick.alias("pick"))
    return r.groupBy("language").agg(rows_().alias("n"), F.count("pick").alias("n_resolved"), F.count_if(F.col("pick") == F.col("answer_index")).alias("n_right"))


@query("m9_bonus_shapes", "flat", sql=f"""with k as (select fact_id, count(*) filter (where pred = gold)::double as k, count(*)::double as n from {JUDGED} group by 1)
 select fact_id, case when k = n then 1.0::double else 0.0::double end as all_or_nothing, round(pow(k / n, 2), 6) as power, case when k / n >= 1 then 1.0::double when k / n >= 0.75 then 0.5::double when k / n >= 0.5 then 0.2::double else 0.0::double end as ladder from k""")
def bonus_shapes(flat):
    x = predictions(flat).groupBy("fact_id").agg(F.count_if("correct").alias("k"), rows_().alias("n"))
    k, n = F.col("k"), F.col("n")
    return x.select("fact_id", M.bonus(k, n, "all").alias("all_or_nothing"), F.round(M.bonus(k, n, "power"), 6).alias("power"), M.bonus(k, n, "ladder", ladder=((1, 1.0), (0.75, 0.5), (0.5, 0.2))).alias("ladder"))


@query("m11_joint_reward", "flat", sql=f"select row_id, round(sum(case when pred = gold then 1.0::double else -0.5::double end) over (partition by fact_id, row_id % 2), 6) as joint from {JUDGED}")
def joint_reward(flat):
    """Each prediction's reward is that of its group: the fact, and its place among the generations modulo their number."""
    p = predictions(flat).select("row_id", "fact_id", (F.col("row_id") % 2).alias("g"), F.when(F.col("correct"), 1.0).otherwise(-0.5).alias("r"))
    groups = p.groupBy("fact_id", "g").agg(F.sum("r").alias("joint"))
    return p.join(groups, ["fact_id", "g"]).select("row_id", F.round("joint", 6).alias("joint"))


@query("m16_head_importance", "embeddings", sql="""with e as (select label, generate_subscripts(embedding, 1) - 1 as head, unnest(embedding)::double as v from embeddings)
 select label, head, round(avg(abs(v)) * 1000 * avg((v < 0)::int), 3) as importance from e group by 1, 2""")
def head_importance(embeddings):
    """Mean size of a gradient times 1,000 times the share of negative ones, of each label and position."""
    e = embeddings.select("label", F.posexplode("embedding").alias("head", "v")).withColumn("v", F.col("v").cast("double"))
    return e.groupBy("label", "head").agg(F.round(F.avg(F.abs("v")) * 1000 * F.avg((F.col("v") < 0).cast("int")), 3).alias("importance"))


@query("m17_both_ways", "embeddings", sql="""with a as (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), b as (select vec_id - 1 as vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 1),
 s as (select a.vec_id as x, b.vec_id as y, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) as sim from a, b where a.vec_id in (select vec_id from b) and b.vec_id in (select vec_id from a)),
 f as (select x, arg_max(y, (sim, -y)) as hit from s group by 1), g as (select y, arg_max(x, (sim, -x)) as hit from s group by 1)
 select (select count(*) from f) as n, round((select avg((x = hit)::int) from f), 6) as forth, round((select avg((y = hit)::int) from g), 6) as back, round(((select avg((x = hit)::int) from f) + (select avg((y = hit)::int) from g)) / 2, 6) as mean""")
def both_ways(embeddings):
    """Retrieval of aligned pairs in both directions: a vector whose id is divisible by 20 and the next one are a pair."""
    from lexiloom.operators.vectors import nearest

    a = embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    b = embeddings.where("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("i"), F.col("embedding").alias("v"))
    a, b = a.join(b.select("i"), "i", "left_semi"), b.join(a.select("i"), "i", "left_semi")
    tagged = lambda x, sign: x.select((F.col("i") * sign - 1 if sign < 0 else F.col("i")).alias("i"), "v")  # noqa: E731  (own ids apart: none is its own neighbour)
    f = nearest(b, tagged(a, -1), "i", "v").select((-F.col("i") - 1 == F.col("nearest")).cast("int").alias("hit"), F.lit("f").alias("d"))
    g = nearest(a, tagged(b, -1), "i", "v").select((-F.col("i") - 1 == F.col("nearest")).cast("int").alias("hit"), F.lit("g").alias("d"))
    x = f.union(g).agg(F.count_if(F.col("d") == "f").alias("n"), F.avg(F.when(F.col("d") == "f", F.col("hit"))).alias("f"), F.avg(F.when(F.col("d") == "g", F.col("hit"))).alias("g"))
    return x.select("n", F.round("f", 6).alias("forth"), F.round("g", 6).alias("back"), F.round((F.col("f") + F.col("g")) / 2, 6).alias("mean"))


_SOFT = "list_transform(scores, lambda s: exp(s) / list_sum(list_transform(scores, lambda t: exp(t))))"


@query("m21_group_divergence", "flat", sql=f"""with p as (select fact_id, language, {_SOFT} as p from {JUDGED}), m as (select fact_id, count(*) as n, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] as q from p group by 1 having count(*) >= 2)
 select fact_id, round(avg({" + ".join(f"q[{i}] * ln(q[{i}] / p[{i}])" for i in (1, 2, 3, 4))}), 6) as divergence from p join m using (fact_id) group by 1""")
def group_divergence(flat):
    """Mean divergence of the languages' option distributions from their mean, facts with two or more languages."""
    e = F.transform("scores", lambda s: F.exp(s))
    p = predictions(flat).select("fact_id", e.alias("e")).select("fact_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    q = p.groupBy("fact_id").agg(rows_().alias("n"), F.array(*[F.avg(F.col("p")[i]) for i in range(4)]).alias("q")).where("n >= 2")
    kl = F.aggregate(F.zip_with("q", "p", lambda a, b: a * F.ln(a / b)), F.lit(0.0), lambda s, x: s + x)
    return p.join(q, "fact_id").groupBy("fact_id").agg(F.round(F.avg(kl), 6).alias("divergence"))


@query("m22_letter_accuracy", "flat", sql=f"select language, count(*) as n, round(avg((pred = gold)::int), 6) as accuracy from {JUDGED} group by 1")
def letter_accuracy(flat):
    return predictions(flat).groupBy("language").agg(rows_().alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("m24_containment", "flat", sql="select language, round(avg(contains(lower(answer_text), lower(object))::int), 6) as accuracy from flat where answer_text is not null and object is not null group by 1")
def containment(flat):
    return flat.where("answer_text is not null and object is not null").groupBy("language").agg(F.round(F.avg(F.contains(F.lower("answer_text"), F.lower("object")).cast("int")), 6).alias("accuracy"))


@query("m25_target_rank", "flat", sql=f"select row_id, len(list_filter(scores, lambda s: s > scores[list_position(ids, gold)])) as rank from {JUDGED} where gold is not null")
def target_rank(flat):
    """How many options score above the gold one."""
    p = predictions(flat).where("gold is not null").withColumn("own", F.get("scores", (F.array_position("ids", F.col("gold")) - 1).cast("int")))
    return p.select("row_id", F.size(F.filter("scores", lambda s: s > F.col("own"))).alias("rank"))


@query("m23_layer_shares", "embeddings", sql="""with e as (select label, generate_subscripts(embedding, 1) - 1 as head, unnest(embedding)::double as v from embeddings), m as (select label, head, round(avg(v), 9) as v from e group by 1, 2), t as (select label, head // 8 as layer from (select *, row_number() over (partition by label order by v desc, head) as r from m) where r <= 10)
 select label, layer, round(10.0 * count(*), 4)::double as pct from t group by 1, 2""")
def layer_shares(embeddings):
    """How the ten positions of largest mean of each label fall into layers of eight, in per cent."""
    m = embeddings.select("label", F.posexplode("embedding").alias("head", "v")).groupBy("label", "head").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
    t = m.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "head"))).where("r <= 10")
    return t.groupBy("label", F.floor(F.col("head") / 8).alias("layer")).agg((10.0 * rows_()).alias("pct"))


# Aggregates

_TEMPLATE = "replace(question, subject, '[X]')"


@query("a20_template_hits", "flat", sql=f"""select {_TEMPLATE} as template, count(*) as n, count(*) filter (where question_verified) as hits, round(100.0 * count(*) filter (where question_verified) / count(*), 4)::double as pct from flat where language = 'en' and question is not null and subject is not null and subject <> '' group by 1""")
def template_hits(flat):
    """Templates of English questions (subjects are English labels), how often each occurs and how often it was verified."""
    x = flat.where("language = 'en' and question is not null and subject is not null and subject <> ''").select(T.template_of(F.col("question"), F.col("subject")).alias("template"), "question_verified")
    return x.groupBy("template").agg(rows_().alias("n"), F.count_if("question_verified").alias("hits")).withColumn("pct", F.round(100.0 * F.col("hits") / F.col("n"), 4))


@query("a21_defect_rates", "flat", sql="""select coalesce(language, 'all') as language, count(*) as n, count(*) filter (where not question_verified) as defects, round(count(*) filter (where not question_verified) / count(*)::double, 6) as rate from flat where language is not null group by rollup (language)""")
def defect_rates(flat):
    x = flat.where("language is not null").rollup("language").agg(rows_().alias("n"), F.count_if(~F.col("question_verified")).alias("defects"))
    return x.where("n > 0").select(F.coalesce("language", F.lit("all")).alias("language"), "n", "defects", F.round(F.col("defects") / F.col("n"), 6).alias("rate"))


@query("a27_coverage", "parallel", sql="""with x as (select map_keys(translations) as langs from parallel), y as (select unnest(langs) as language, list_sort(langs)[1] as prime from x) select language, prime, count(*) as n from y group by 1, 2""")
def coverage(parallel):
    """Rows by each language that they have and by their primary one, the first by name."""
    langs = F.map_keys("translations")
    return parallel.select(F.array_min(langs).alias("prime"), F.explode(langs).alias("language")).groupBy("language", "prime").agg(rows_().alias("n"))


@query("a30_correct_overlap", "flat", sql=f"""with c as (select fact_id, language from {JUDGED} where pred = gold), n as (select language, count(*) as n from c group by 1), p as (select a.language as la, b.language as lb, count(*) as k from c a join c b on a.fact_id = b.fact_id and a.language < b.language group by 1, 2)
 select la as lang_a, lb as lang_b, round(k / (x.n + y.n - k)::double, 6) as jaccard from p join n x on x.language = la join n y on y.language = lb""")
def correct_overlap(flat):
    """Jaccard of the sets of facts that two languages get right, from sizes and joint counts; no set is gathered."""
    c = predictions(flat).where("correct").select("fact_id", "language")
    n = c.groupBy("language").agg(rows_().alias("n"))
    per = c.groupBy("fact_id").agg(F.array_sort(F.collect_set("language")).alias("l"))  # twelve languages
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, 20), lambda b: F.struct(a.alias("lang_a"), b.alias("lang_b")))))
    k = per.select(F.explode(pairs).alias("p")).groupBy("p.lang_a", "p.lang_b").agg(rows_().alias("k"))
    x = k.join(F.broadcast(n.withColumnsRenamed({"language": "lang_a", "n": "na"})), "lang_a").join(F.broadcast(n.withColumnsRenamed({"language": "lang_b", "n": "nb"})), "lang_b")  # twelve rows
    return x.select("lang_a", "lang_b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query("a32_list_lengths", "flat", sql="select language, sum(len(option_ids))::bigint as n from flat where option_ids is not null group by 1")
def list_lengths(flat):
    return flat.where("option_ids is not null").groupBy("language").agg(F.sum(F.size("option_ids")).alias("n"))


@query("a36_headline", "flat", sql=f"""with j as (select j.*, s.split from {JUDGED} j join (select row_id, split from flat) s using (row_id)), f as (select split, fact_id, count(*) as n, count(*) filter (where pred = gold) as k, count(distinct pred) as d from j group by 1, 2)
 select split, count(*) as n_facts, sum(n)::bigint as n_rows, round(sum(k) / sum(n)::double, 6) as accuracy, round(avg((k = n)::int), 6) as all_right, round(avg((k < n and d = 1)::int), 6) as agree_wrong, round(avg(k), 6) as mean_right from f group by 1""")
def headline(flat):
    """Six numbers of each split: facts, rows, accuracy, facts wholly right, facts that agree on a wrong entity, mean number right."""
    j = predictions(flat).join(flat.select("row_id", "split"), "row_id")
    f = j.groupBy("split", "fact_id").agg(rows_().alias("n"), F.count_if("correct").alias("k"), F.countDistinct("pred").alias("d"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return f.groupBy("split").agg(rows_().alias("n_facts"), F.sum("n").alias("n_rows"), F.round(F.sum("k") / F.sum("n"), 6).alias("accuracy"), share(F.col("k") == F.col("n")).alias("all_right"), share((F.col("k") < F.col("n")) & (F.col("d") == 1)).alias("agree_wrong"), F.round(F.avg("k"), 6).alias("mean_right"))


@query("a37_improvements", "flat", sql=f"""with j as (select language, relation, split, (pred = gold)::int as c from {JUDGED} j join (select row_id, relation, split from flat) s using (row_id) where relation is not null and gold is not null), m as (select language, relation, avg(c) filter (where split = 'train') as b, avg(c) filter (where split = 'test') as g from j group by 1, 2)
 select language, count(*) as n_relations, count(*) filter (where g > b) as improved, round(avg(b), 6) as seen, round(avg(g), 6) as unseen from m where b is not null and g is not null group by 1""")
def improvements(flat):
    """Per language the relations in which test beats train, and the mean of either over relations."""
    j = predictions(flat).where("gold is not null").select("row_id", "language", F.col("correct").cast("int").alias("c")).join(flat.where("relation is not null").select("row_id", "relation", "split"), "row_id")
    m = j.groupBy("language", "relation").agg(*[F.avg(F.when(F.col("split") == s, F.col("c"))).alias(x) for s, x in (("train", "b"), ("test", "g"))]).where("b is not null and g is not null")
    return m.groupBy("language").agg(rows_().alias("n_relations"), F.count_if(F.col("g") > F.col("b")).alias("improved"), F.round(F.avg("b"), 6).alias("seen"), F.round(F.avg("g"), 6).alias("unseen"))


@query("a38_layer_delta", "embeddings", sql="""with e as (select label, generate_subscripts(embedding, 1) - 1 as layer, unnest(embedding)::double as v from embeddings), m as (select label, layer, avg(v) as v from e group by 1, 2)
 select a.label, a.layer, round(a.v - b.v, 6) as delta from m a join m b on a.layer = b.layer and b.label = 0 where a.label <> 0""")
def layer_delta(embeddings):
    """Each label's mean at each position less that of label 0, the base."""
    m = embeddings.select("label", F.posexplode("embedding").alias("layer", "v")).groupBy("label", "layer").agg(F.avg(F.col("v").cast("double")).alias("v"))
    base = m.where("label = 0").select("layer", F.col("v").alias("b"))
    return m.where("label <> 0").join(base, "layer").select("label", "layer", F.round(F.col("v") - F.col("b"), 6).alias("delta"))


@query("a39_prefixes", "flat", sql=f"""with f as (select fact_id, avg((pred = gold)::int) as a, bool_and(pred = gold)::int as t from {JUDGED} group by 1), r as (select *, row_number() over (order by fact_id) as i from (select * from f order by fact_id limit 150)), p as (select * from (values ('0:100', 0, 100), ('0:150', 0, 150), ('100:150', 100, 150)) v(part, lo, hi))
 select part, count(*) as n, round(avg(a), 6) as accuracy, round(avg(t), 6) as all_right from p join r on i > lo and i <= hi group by 1""")
def prefixes(flat):
    """Accuracy over the first 100 and 150 facts by id and those between: what the choice of a validation prefix changes."""
    f = predictions(flat).groupBy("fact_id").agg(F.avg(F.col("correct").cast("int")).alias("a"), F.bool_and("correct").cast("int").alias("t"))
    r = f.orderBy("fact_id").limit(150).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("fact_id")))  # 150 rows
    parts = F.array(*[F.when((F.col("i") > lo) & (F.col("i") <= hi), F.lit(f"{lo}:{hi}")) for lo, hi in ((0, 100), (0, 150), (100, 150))])
    return r.withColumn("part", F.explode(F.array_compact(parts))).groupBy("part").agg(rows_().alias("n"), F.round(F.avg("a"), 6).alias("accuracy"), F.round(F.avg("t"), 6).alias("all_right"))


# Orders and limits


@query("o5_least_entropy", "flat", sql=f"with e as (select row_id, round(list_sum(list_transform({_SOFT}, lambda p: -p * ln(p + 1e-9))), 6) as entropy from {JUDGED}) select row_id, entropy from e order by entropy, row_id limit 50")
def least_entropy(flat):
    """The 50 predictions of least entropy, over all languages."""
    e = F.transform("scores", lambda s: F.exp(s))
    p = predictions(flat).select("row_id", e.alias("e")).select("row_id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    return p.select("row_id", F.round(entropy(F.col("p")), 6).alias("entropy")).orderBy("entropy", "row_id").limit(50)


@query("o8_costliest", "documents", sql="select doc_id, length(text) as cost from documents where text is not null order by cost desc, doc_id limit 100")
def costliest(documents):
    return documents.where("text is not null").select("doc_id", F.length("text").alias("cost")).orderBy(F.desc("cost"), "doc_id").limit(100)


@query("o9_first_facts", "flat", sql="select row_id from flat where fact_id in (select fact_id from flat where fact_id is not null group by 1 order by min(row_id), fact_id limit 200)")
def first_facts(flat):
    """All rows of the 200 facts that appear first."""
    first = flat.where("fact_id is not null").groupBy("fact_id").agg(F.min("row_id").alias("at")).orderBy("at", "fact_id").limit(200)
    return flat.select("row_id", "fact_id").join(F.broadcast(first.select("fact_id")), "fact_id", "left_semi").select("row_id")  # 200 rows


@query("o12_general_heads", "embeddings", sql="""with e as (select label, generate_subscripts(embedding, 1) - 1 as head, unnest(embedding)::double as v from embeddings), m as (select label, head, round(avg(v), 9) as v from e group by 1, 2), q as (select label, quantile_cont(v, 0.9) as q from m group by 1), s as (select head, count(*) as n from m join q using (label) where v >= q - 1e-12 group by 1)
 select head, n, case when n >= greatest(2, (select count(distinct label) from embeddings) - 1) then 'general' when n = 1 then 'specific' else 'shared' end as kind from s""")
def general_heads(embeddings):
    """Positions above the 0.9 quantile of a label's means, by how many labels have them there."""
    m = embeddings.select("label", F.posexplode("embedding").alias("head", "v")).groupBy("label", "head").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
    q = m.groupBy("label").agg(F.percentile("v", 0.9).alias("q"))
    s = m.join(q, "label").where(F.col("v") >= F.col("q") - 1e-12).groupBy("head").agg(rows_().alias("n"))
    every = q.agg(rows_().alias("labels"))
    kind = F.when(F.col("n") >= F.greatest(F.lit(2), F.col("labels") - 1), "general").when(F.col("n") == 1, "specific").otherwise("shared")
    return s.join(F.broadcast(every)).select("head", "n", kind.alias("kind"))  # one row


# Scans that leave out what is there, unions


@query("s19_still_to_fetch", "parallel", "entity_labels", sql="select distinct object_id as id from parallel where object_id is not null and object_id not in (select id from entity_labels where id is not null) order by 1")
def still_to_fetch(parallel, labels):
    """Ids that no fetched label covers yet: what a resumed fetch still has to ask for."""
    return parallel.where("object_id is not null").select(F.col("object_id").alias("id")).distinct().join(labels.select("id"), "id", "left_anti")


@query("s16_by_language", "eval_items", sql="select lang, count(*) as n, count(distinct benchmark_name) as n_benchmarks, count(*) filter (where answer in ('A', 'B', 'C', 'D')) as n_valid from eval_items group by 1")
def by_language(items):
    return items.groupBy("lang").agg(rows_().alias("n"), F.countDistinct("benchmark_name").alias("n_benchmarks"), F.count_if(F.col("answer").isin("A", "B", "C", "D")).alias("n_valid"))


@query("s26_first_subjects", "documents", sql="""with f as (select source, subject_id, min(doc_id) as first_id from documents where subject_id is not null group by 1, 2), r as (select source, subject_id, row_number() over (partition by source order by first_id) as r from f)
 select d.doc_id from documents d join r on d.source is not distinct from r.source and d.subject_id = r.subject_id where r <= 2""")
def first_subjects(documents):
    """All documents of the first two subjects of each source."""
    f = documents.where("subject_id is not null").groupBy("source", "subject_id").agg(F.min("doc_id").alias("at"))
    r = f.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("at"))).where("r <= 2")
    d = documents.select("doc_id", F.col("source").alias("s"), F.col("subject_id").alias("i"))
    return d.join(r, d.s.eqNullSafe(r.source) & (d.i == r.subject_id), "left_semi").select("doc_id")


@query("s27_language_budget", "documents", sql="""select lang, count(*) as n, sum(least(n, 5000 - before))::bigint as n_tokens from (select lang, n, sum(n) over (partition by lang order by doc_id rows unbounded preceding) - n as before from (select lang, doc_id, length(text) // 4 as n from documents where text is not null and lang is not null)) where before < 5000 group by 1""")
def language_budget(documents):
    """Texts of each language up to 5,000 estimated tokens; the one that crosses the budget is cut there."""
    x = documents.where("text is not null and lang is not null").select("lang", "doc_id", T.estimated_tokens(F.col("text")).alias("n"))
    x = W.in_order(x, ["lang"], ["doc_id"], W.range_slices(documents, "doc_id"), "n").where("_before < 5000")
    return x.groupBy("lang").agg(rows_().alias("n"), F.sum(F.least(F.col("n"), 5000 - F.col("_before"))).alias("n_tokens"))


@query("s9_aligned_rows", "flat", "parallel", sql="""with f as (select fact_id, language, row_number() over (partition by fact_id, language order by row_id) as i, question as q from flat where fact_id is not null), p as (select fact_id, row_number() over (partition by fact_id order by row_id) as i, translations as t from parallel where fact_id is not null),
 n as (select fact_id, i, unnest(map_keys(t)) as language, unnest(map_values(t)).question as q from p) select f.language, count(*) as n, count(*) filter (where f.q is not distinct from n.q) as equal from f join n on f.fact_id = n.fact_id and f.language = n.language and f.i = n.i group by 1""")
def aligned_rows(flat, parallel):
    """The n-th row of a fact in one table beside the n-th in the other, whatever the layout of either: how many questions agree."""
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("row_id"))
    f = flat.where("fact_id is not null").select("fact_id", "language", at("fact_id", "language").alias("i"), F.col("question").alias("q"))
    n = parallel.where("fact_id is not null").select("fact_id", at("fact_id").alias("i"), "translations").select("fact_id", "i", F.explode("translations").alias("language", "t")).select("fact_id", "i", "language", F.col("t.question").alias("p"))
    return f.join(n, ["fact_id", "language", "i"]).groupBy("language").agg(rows_().alias("n"), F.count_if(F.col("q").eqNullSafe(F.col("p"))).alias("equal"))


@query("u2_extend", "documents", "eval_items", sql="select 'documents' as origin, count(*) as n, sum(length(text))::bigint as n_chars from documents where text is not null union all select benchmark_name, count(*), sum(length(passage))::bigint from eval_items where passage is not null group by 1")
def extend(documents, items):
    """Texts of several sources under one schema, with their origin."""
    a = documents.where("text is not null").select(F.lit("documents").alias("origin"), "text")
    b = items.where("passage is not null").select(F.col("benchmark_name").alias("origin"), F.col("passage").alias("text"))
    return a.unionByName(b).groupBy("origin").agg(rows_().alias("n"), F.sum(F.length("text")).alias("n_chars"))


# Texts


@query("t_truth", "entity_labels", sql=r"""select id, l as language, coalesce(nullif(labels[l], ''), nullif(trim(regexp_replace(labels['en'], '\s*\([^()]*\)$', '')), '')) as truth from entity_labels, unnest(['de', 'ja', 'sw']) t(l)""")
def truth(labels):
    """What an entity should be called: its label, or else its English label without a bracketed ending."""
    plain = F.nullif(F.trim(F.regexp_replace(F.col("labels")["en"], r"\s*\([^()]*\)$", "")), F.lit(""))
    return labels.select("id", "labels", F.explode(F.array(*map(F.lit, ("de", "ja", "sw")))).alias("language")).select("id", "language", F.coalesce(F.nullif(F.element_at("labels", F.col("language")), F.lit("")), plain).alias("truth"))


@query("t_evidence", "flat", "entity_labels", sql=f"""with l as (select id, k as language, min(v) as label from (select id, unnest(map_keys(labels)) as k, unnest(map_values(labels)) as v from entity_labels) where v <> '' group by 1, 2), a as (select id, list_distinct(list({NORM.format('label')})) as names from l group by 1),
 f as (select language, answer_text as t, option_ids[answer_index + 1] as id from flat where answer_text is not null and answer_index is not null)
 select f.language, case when label = t then 'verified' when {NORM.format('label')} = {NORM.format('t')} then 'variant' when list_contains(names, {NORM.format('t')}) then 'alias' when label is not null then 'contradicts' else 'no ground truth' end as evidence, count(*) as n from f left join l on l.id = f.id and l.language = f.language left join a on a.id = f.id group by 1, 2""")
def evidence(flat, labels):
    """How well the labels bear out an answer: the same, the same but for case and punctuation, a name in another
    language, a different name, or nothing to hold it against."""
    l = labels.select("id", F.explode("labels").alias("language", "label")).where("label <> ''").groupBy("id", "language").agg(F.min("label").alias("label"))  # noqa: E741
    a = l.groupBy("id").agg(F.collect_set(T.norm(F.col("label"))).alias("names"))  # twelve languages
    f = flat.where("answer_text is not null and answer_index is not null").select("language", F.col("answer_text").alias("t"), F.get("option_ids", F.col("answer_index").cast("int")).alias("id"))
    f = f.groupBy("language", "t", "id").agg(rows_().alias("n"))  # combined first: a frequent answer is one row
    x = f.join(l, ["id", "language"], "left").join(a, "id", "left")
    t = T.norm(F.col("t"))
    kind = F.when(F.col("label") == F.col("t"), "verified").when(T.norm(F.col("label")) == t, "variant").when(F.array_contains("names", t), "alias").when(F.col("label").isNotNull(), "contradicts").otherwise("no ground truth")
    return x.groupBy("language", kind.alias("evidence")).agg(F.sum("n").alias("n"))


#: Headings of an answer, longest first.
ANSWER_LABELS = ("the correct answer is", "correct answer", "the answer is", "answer")


@query("t_strip_label", "flat", sql=rf"select row_id, regexp_replace(answer_text, '(?i)^\s*({'|'.join(ANSWER_LABELS)})(\s*[:：]\s*|\s+)', '') as t from flat")
def strip_label(flat):
    """An answer without its heading, which must be followed by a colon or a space."""
    return flat.select("row_id", F.regexp_replace("answer_text", rf"(?i)^\s*({'|'.join(ANSWER_LABELS)})(\s*[:：]\s*|\s+)", "").alias("t"))


@query("t_resolve_answer", "flat", sql=f"""select row_id, coalesce(list_filter([option_a, option_b, option_c, option_d], lambda o: o = answer_text)[1], list_filter([option_a, option_b, option_c, option_d], lambda o: {NORM.format('o')} = {NORM.format('answer_text')})[1], object) as t from flat""")
def resolve_answer(flat):
    """The option that an answer is, exactly or else normalised; the gold object where it is none."""
    o = F.array(*[f"option_{c}" for c in "abcd"])
    same = F.get(F.filter(o, lambda x: x == F.col("answer_text")), F.lit(0))
    near = F.get(F.filter(o, lambda x: T.norm(x) == T.norm(F.col("answer_text"))), F.lit(0))
    return flat.select("row_id", F.coalesce(same, near, "object").alias("t"))


@query("t_concord", "flat", sql=r"select row_id, regexp_replace(regexp_replace(question, '\bde le\b', 'du', 'g'), '\bde les\b', 'des', 'g') as t from flat where language = 'fr' and question is not null")
def concord(flat):
    """French contractions put right, one after the other."""
    return flat.where("language = 'fr' and question is not null").select("row_id", F.regexp_replace(F.regexp_replace("question", r"\bde le\b", "du"), r"\bde les\b", "des").alias("t"))


@query("t_parse_candidates", "flat", sql="""select row_id, case when s like '[%]' and s not like '%"%' then len(string_split(s[2:-2], ''', ''')) else 0 end as n from (select row_id, '[''' || concat_ws(''', ''', option_a, option_b, option_c, option_d) || ''']' as s from flat where option_a is not null)""")
def parse_candidates(flat):
    """A list written as a literal is parsed; what can't be gives an empty list."""
    s = F.concat(F.lit("['"), F.concat_ws("', '", *[f"option_{c}" for c in "abcd"]), F.lit("']"))
    x = flat.where("option_a is not null").select("row_id", s.alias("s"))
    ok = F.col("s").startswith("[") & F.col("s").endswith("]") & ~F.contains("s", F.lit('"'))
    return x.select("row_id", F.when(ok, F.size(F.split("s", "', '"))).otherwise(0).alias("n"))


@query("f_mask", "flat", sql="select row_id, question from flat where question_verified is not false and question is not null and answer_index is not null")
def mask(flat):
    """Rows whose flags hold; the schema stays as it is."""
    keep = F.coalesce("question_verified", F.lit(True)) & F.col("question").isNotNull() & F.col("answer_index").isNotNull()
    return flat.where(keep).select("row_id", "question")


@query("f_common_noun", "flat", sql="""select relation, round(avg((substr(object, 1, 1) = lower(substr(object, 1, 1)))::int), 6) as share, coalesce(avg((substr(object, 1, 1) = lower(substr(object, 1, 1)))::int) > 0.15, false) as common from flat where language = 'en' and object <> '' group by 1""")
def common_noun(flat):
    """Relations whose objects are common nouns: more than 0.15 of their English labels begin in lower case."""
    first = F.substring("object", 1, 1)
    x = flat.where("language = 'en' and object <> ''").groupBy("relation").agg(F.avg((first == F.lower(first)).cast("int")).alias("s"))
    return x.select("relation", F.round("s", 6).alias("share"), F.coalesce(F.col("s") > 0.15, F.lit(False)).alias("common"))


# Packing and validation


@query("w2_round_robin_packs", "documents")
def round_robin_packs(documents):
    """(lang, chunk, turn, n_texts, n_tokens): packs of each language in the order in which they are emitted, one of
    each language in turn. Rows without a language are left out; each language is packed in the order of its ids."""
    packed = W.pack(documents.where("lang is not null"), "lang", "doc_id", "text", 1000)
    return packed.select("lang", "chunk", F.struct("chunk", "lang").alias("turn"), "n_texts", "n_tokens").orderBy("turn").select("lang", "chunk", "n_texts", "n_tokens")


@query("w12_balanced_buckets", "documents", sql="""with g as (select subject_id, sum(coalesce(length(text), 0))::bigint as size from documents where subject_id is not null group by 1), r as (select *, (row_number() over (order by size desc, subject_id) - 1) % 16 as i from g)
 select subject_id, size, (case when i < 8 then i else 15 - i end)::bigint as bucket from r""")
def balanced_buckets(documents):
    """Subjects in eight buckets of like size: largest first, to and fro over the buckets. The least filled bucket of each
    moment depends on all groups before; this comes as near as the smallest groups are small, without that sequence."""
    g = documents.where("subject_id is not null").groupBy("subject_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")).withColumn("less", -F.col("size"))
    x = W.in_order(g, [], ["less", "subject_id"], W.range_slices(g, "less")).withColumn("i", (F.col("_nth") - 1) % 16)
    return x.select("subject_id", "size", F.when(F.col("i") < 8, F.col("i")).otherwise(15 - F.col("i")).cast("bigint").alias("bucket"))


#: What a row of the fact table must look like.
PARALLEL = (
    "fact_id string, subject string, subject_id string, relation string, property_id string, object string, object_id string, n_langs_verified bigint, translations map<string,struct<question:string,answer_text:string,"
    "answer_index:bigint,option_a:string,option_b:string,option_c:string,option_d:string,option_ids:array<string>,question_verified:boolean,question_regenerated:boolean>>"
)


def schema_faults(found: DataType, asked: DataType, path: str = "") -> list[tuple[str, str, str]]:
    """(path, asked, found) of whatever a schema lacks or has of another type, however deep; more fields are no fault."""
    if isinstance(asked, StructType):
        if not isinstance(found, StructType):
            return [(path, "struct", found.simpleString())]
        have = {f.name: f.dataType for f in found}
        return [x for f in asked for x in (schema_faults(have[f.name], f.dataType, f"{path}.{f.name}".lstrip(".")) if f.name in have else [(f"{path}.{f.name}".lstrip("."), f.dataType.simpleString(), "missing")])]
    if isinstance(asked, ArrayType) and isinstance(found, ArrayType):
        return schema_faults(found.elementType, asked.elementType, path + "[]")
    if isinstance(asked, MapType) and isinstance(found, MapType):
        return schema_faults(found.keyType, asked.keyType, path + "{key}") + schema_faults(found.valueType, asked.valueType, path + "{}")
    return [] if asked == found else [(path, asked.simpleString(), found.simpleString())]


@query("n8_schema_faults", "parallel", "flat")
def faults(parallel, flat):
    """What the fact table lacks, and what a flat row would lack if it were one."""
    asked = StructType.fromDDL(PARALLEL)
    rows = [(name, *x) for name, t in (("parallel", parallel), ("flat", flat)) for x in schema_faults(t.schema, asked)]
    return parallel.sparkSession.createDataFrame(rows, "table_name string, path string, asked string, found string")


# Nested rows


@query("n3_new_field", "parallel", sql="""select row_id, list_sum(list_transform(map_values(translations), lambda t: len(list_filter([t.option_a, t.option_b, t.option_c, t.option_d], lambda o: o is not null))))::bigint as n_options from parallel where cardinality(translations) > 0""")
def new_field(parallel):
    """Each translation gets a further field, its number of options; the row then adds them up."""
    n = lambda t: F.size(F.array_compact(F.array(*[t[f"option_{c}"] for c in "abcd"])))
    x = parallel.where("cardinality(translations) > 0").withColumn("translations", F.transform_values("translations", lambda k, t: t.withField("n_options", n(t))))
    return x.select("row_id", F.aggregate(F.map_values("translations"), F.lit(0).cast("bigint"), lambda a, t: a + t["n_options"]).alias("n_options"))


_ERRORS = (("no question", "question is null"), ("no answer", "answer_text is null"), ("no index", "answer_index is null"), ("index out of range", "answer_index < 0 or answer_index > 3"), ("no option", "option_a is null or option_b is null or option_c is null or option_d is null"), ("no fact", "fact_id is null"))


@query("n10_error_samples", "flat", sql="with e as (" + " union all ".join(f"select '{k}' as error, row_id from flat where {c}" for k, c in _ERRORS) + ") select error, count(*) as n, array_to_string(list_sort(list(row_id))[1:3], ',') as samples from e group by 1")
def error_samples(flat):
    """All errors are counted, the first three rows of each kept."""
    kinds = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in _ERRORS]))
    e = flat.select("row_id", F.explode(kinds).alias("error"))
    n = e.groupBy("error").agg(rows_().alias("n"))
    top = e.withColumn("r", F.row_number().over(Window.partitionBy("error").orderBy("row_id"))).where("r <= 3")
    samples = top.groupBy("error").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row_id")), lambda x: x.cast("string")), ",").alias("samples"))  # three rows
    return n.join(samples, "error")


@query("n12_repeated_verdicts", "flat", sql="select fact_id, language, count(*) as n, count(distinct question_verified) > 1 as conflicting from flat where fact_id is not null group by 1, 2 having count(*) > 1")
def repeated_verdicts(flat):
    """Facts judged more than once in a language, and whether the verdicts disagree."""
    x = flat.where("fact_id is not null").groupBy("fact_id", "language").agg(rows_().alias("n"), F.countDistinct("question_verified").alias("d")).where("n > 1")
    return x.select("fact_id", "language", "n", (F.col("d") > 1).alias("conflicting"))


@query("k3_nested_again", "flat", sql="""with f as (select fact_id, language, arg_min(answer_text, row_id) as t from flat where fact_id is not null and answer_text is not null group by 1, 2) select fact_id, count(*) as n_langs, array_to_string(list_sort(list(language || '=' || t)), ';') as answers from f group by 1""")
def nested_again(flat):
    """Rows of the languages put together into one nested row a fact, shown as text."""
    f = flat.where("fact_id is not null and answer_text is not null").groupBy("fact_id", "language").agg(F.min_by("answer_text", "row_id").alias("t"))
    m = f.groupBy("fact_id").agg(F.map_from_entries(F.collect_list(F.struct("language", F.struct(F.col("t").alias("answer_text"))))).alias("m"))  # twelve languages
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["answer_text"]))
    return m.select("fact_id", F.cardinality("m").cast("bigint").alias("n_langs"), F.array_join(F.array_sort(entries), ";").alias("answers"))
