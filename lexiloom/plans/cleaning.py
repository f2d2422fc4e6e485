"""Scans, filters, predicates and text functions over the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.plans.registry import query

NORM = r"trim(regexp_replace(lower({}), '[^\pL\pN]+', ' ', 'g'))"
LEAK = r"""case when language in ('ja', 'zh') then length(lower(trim(answer_text, ' '))) >= 2 and contains(lower(question), lower(trim(answer_text, ' ')))
 else length(lower(trim(answer_text, ' '))) >= 3 and regexp_matches(lower(question), '(^|[^\pL\pN_])' || regexp_escape(lower(trim(answer_text, ' '))) || '($|[^\pL\pN_])') end"""


@query("s2_tolerant_json", "events", sql="""select event_type, count(*) as n, count(try_cast(json_extract_string(props, '$.k') as bigint)) as n_k,
 sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k from events group by 1""")
def tolerant_json(events):
    k = F.expr("try_cast(get_json_object(props, '$.k') as bigint)")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


@query("s3_ntriples", "parallel", sql=r"""with l as (select row_id, '<http://e/' || trim(subject_id, ' ') || '> <http://p/' || trim(property_id, ' ') || '> <http://e/' || trim(object_id, ' ') || '> .' as line from parallel)
 select row_id, regexp_extract(line, '^<[^<>]*/(Q[0-9]+)> <', 1) as s, regexp_extract(line, '<[^<>]*/(P[0-9]+)> <', 1) as p, regexp_extract(line, '<[^<>]*/(Q[0-9]+)> \.$', 1) as o
 from l where regexp_matches(line, '^<[^<>]*/Q[0-9]+> <[^<>]*/P[0-9]+> <[^<>]*/Q[0-9]+> \.$')""")
def ntriples(parallel):
    from lexiloom.sources.readers import parse_ntriples

    line = F.format_string("<http://e/%s> <http://p/%s> <http://e/%s> .", F.trim("subject_id"), F.trim("property_id"), F.trim("object_id"))
    whole = F.col("subject_id").isNotNull() & F.col("property_id").isNotNull() & F.col("object_id").isNotNull()
    return parse_ntriples(parallel.where(whole).select("row_id", line.alias("value")))


@query("s6_types", "entity_types", sql="select id, list_sort(list_distinct(flatten(list(types))))::varchar as types from entity_types group by id")
def types(entity_types):
    return entity_types.groupBy("id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ", "), F.lit("]")).alias("types"))


@query("s14_complete_relations", "flat", sql="""select relation, count(*) as n from flat where relation in (select relation from flat where relation is not null group by 1
 having count(distinct language) = (select count(distinct language) from flat)) group by 1""")
def complete_relations(flat):
    n = flat.agg(F.countDistinct("language").alias("all"))
    whole = flat.where("relation is not null").groupBy("relation").agg(F.countDistinct("language").alias("n_lang")).join(F.broadcast(n), F.col("n_lang") == F.col("all"), "left_semi")  # one row
    return flat.join(whole, "relation", "left_semi").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("f_allow_list", "parallel", sql="select row_id, property_id from parallel where property_id in ('P41007', 'P41144', 'P41281')")
def allow_list(parallel):
    return parallel.where(F.col("property_id").isin("P41007", "P41144", "P41281")).select("row_id", "property_id")


@query("f_existence", "parallel", "entity_labels", sql="""select row_id from parallel where object_id in (select id from entity_labels) and property_id in (select id from entity_labels)""")
def existence(parallel, labels):
    ids = labels.select("id").distinct()
    rows = parallel.join(ids, parallel.object_id == ids.id, "left_semi")
    return rows.join(ids, rows.property_id == ids.id, "left_semi").select("row_id")


@query("f_coverage", "entity_labels", sql="""select id, count(*) filter (where trim(v) <> '') as n from (select id, unnest(map_values(labels)) as v from entity_labels) group by 1 having n >= 5""")
def coverage(labels):
    cells = labels.select("id", F.explode(F.map_values("labels")).alias("v"))
    return cells.groupBy("id").agg(F.count_if(F.trim("v") != "").alias("n")).where("n >= 5")


@query("f_relation_exclusion", "parallel", sql="select row_id from parallel where not coalesce(relation in ('anthem', 'currency', 'capital'), false)")
def relation_exclusion(parallel):
    return parallel.where(~F.coalesce(F.col("relation").isin("anthem", "currency", "capital"), F.lit(False))).select("row_id")


@query("f_pruned_map", "entity_labels", sql="""select id, lang, label from (select id, unnest(map_keys(labels)) as lang, unnest(map_values(labels)) as label from entity_labels) where lang in ('en', 'de', 'fr') and trim(label) <> ''""")
def pruned_map(labels):
    kept = F.map_filter("labels", lambda k, v: k.isin("en", "de", "fr") & (F.trim(v) != ""))
    return labels.select("id", F.explode(kept).alias("lang", "label"))


@query("f_item_validity", "flat", sql="""select row_id, (a and b and c and d and array_length(list_distinct([option_a, option_b, option_c, option_d])) = 4 and coalesce(list_contains([option_a, option_b, option_c, option_d], answer_text), false)) as valid from
 (select *, coalesce(trim(option_a, ' ') <> '', false) a, coalesce(trim(option_b, ' ') <> '', false) b, coalesce(trim(option_c, ' ') <> '', false) c, coalesce(trim(option_d, ' ') <> '', false) d from flat)""")
def item_validity(flat):
    o = F.array("option_a", "option_b", "option_c", "option_d")
    full = F.forall(o, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return flat.select("row_id", (full & (F.size(F.array_distinct(o)) == 4) & F.coalesce(F.array_contains(o, F.col("answer_text")), F.lit(False))).alias("valid"))


@query("f_item_normaliser", "flat", sql="""select row_id, coalesce(list_position([option_a, option_b, option_c, option_d], answer_text) - 1, case when answer_index between 0 and 3 then answer_index end) as gold_idx from flat""")
def item_normaliser(flat):
    at = F.array_position(F.array("option_a", "option_b", "option_c", "option_d"), F.col("answer_text"))
    return flat.select("row_id", F.coalesce(F.when(at > 0, at - 1), F.when(F.col("answer_index").between(0, 3), F.col("answer_index"))).alias("gold_idx"))


@query("f_answer_leak", "flat", sql=f"select row_id from flat where {LEAK}")
def answer_leak(flat):
    return flat.where(T.leaks(F.col("answer_text"), F.col("question"), F.col("language"))).select("row_id")


@query("f_answer_leak_substring", "flat", sql="select row_id from flat where length(answer_text) > 2 and contains(lower(question), lower(answer_text))")
def answer_leak_substring(flat):
    return flat.where((F.length("answer_text") > 2) & F.contains(F.lower("question"), F.lower("answer_text"))).select("row_id")


@query("f_subject_mention", "flat", sql="""select row_id, case when len(w) > 0 then len(list_filter(w, lambda x: contains(q, x))) > 0 else contains(q, lower(subject)) end as mentioned from
 (select row_id, subject, lower(question) q, list_filter(string_split(lower(subject), ' '), lambda x: length(x) >= 4) w from flat where language = 'en' and subject is not null and question is not null)""")
def subject_mention(flat):
    rows = flat.where("language = 'en' and subject is not null and question is not null")
    return rows.select("row_id", T.mentions(F.col("question"), F.col("subject")).alias("mentioned"))


@query("f_attested_name", "flat", "entity_labels", sql="""with g as (select row_id, language, question, option_ids[answer_index + 1] as id from flat where answer_index between 0 and 3 and question is not null),
 l as (select id, unnest(map_keys(labels)) as language, unnest(map_values(labels)) as label from entity_labels)
 select row_id, max(case when label <> '' and contains(question, label) then 1 else 0 end) as named from g join l using (id, language) group by 1""")
def attested_name(flat, labels):
    gold = flat.where("answer_index between 0 and 3 and question is not null").select("row_id", "language", "question", F.get("option_ids", F.col("answer_index").cast("int")).alias("id"))
    said = labels.select("id", F.explode("labels").alias("language", "label"))
    return gold.join(said, ["id", "language"]).groupBy("row_id").agg(F.max(F.when((F.col("label") != "") & F.contains("question", "label"), 1).otherwise(0)).alias("named"))


@query("f_model_number", "parallel", sql="select row_id from parallel where regexp_matches(subject, '[0-9]+$')")
def model_number(parallel):
    return parallel.where(F.col("subject").rlike("[0-9]+$")).select("row_id")


@query("f_foreign_script", "flat", sql=r"select row_id from flat where language in ('en', 'de', 'fr', 'es', 'pt', 'id', 'sw') and regexp_matches(answer_text, '[\p{Cyrillic}\p{Arabic}\p{Bengali}\p{Han}\p{Hiragana}\p{Katakana}]')")
def foreign_script(flat):
    return flat.where(F.col("language").isin("en", "de", "fr", "es", "pt", "id", "sw") & F.col("answer_text").rlike(r"[\p{IsCyrillic}\p{IsArabic}\p{IsBengali}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")).select("row_id")


@query("f_required_script", "flat", sql=r"""select row_id from flat where question is not null and not (case language when 'ru' then regexp_matches(question, '\p{Cyrillic}') when 'ar' then regexp_matches(question, '\p{Arabic}') when 'bn' then regexp_matches(question, '\p{Bengali}')
 when 'ja' then regexp_matches(question, '[\p{Hiragana}\p{Katakana}]') when 'zh' then regexp_matches(question, '\p{Han}') else regexp_matches(question, '\p{Latin}') end)""")
def required_script(flat):
    q, s = F.col("question"), T.scripts()
    has = F.when(F.col("language") == "ru", q.rlike(s["cyrillic"])).when(F.col("language") == "ar", q.rlike(s["arabic"])).when(F.col("language") == "bn", q.rlike(s["bengali"])).when(F.col("language") == "ja", q.rlike(s["kana"])).when(F.col("language") == "zh", q.rlike(s["han"])).otherwise(q.rlike(s["latin"]))
    return flat.where(q.isNotNull() & ~has).select("row_id")


@query("f_mixed_script", "flat", sql=r"select row_id, field from (select row_id, 'answer_text' as field, answer_text as t from flat union all select row_id, 'subject', subject from flat) where regexp_matches(t, '\p{Latin}\pM*[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Bengali}]|[\p{Cyrillic}\p{Greek}\p{Arabic}\p{Bengali}]\pM*\p{Latin}')")
def mixed_script(flat):
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("answer_text", "subject")])).alias("c")
    other = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsBengali}]"
    return flat.select("row_id", t).where(F.col("c.t").rlike(rf"\p{{IsLatin}}\p{{M}}*{other}|{other}\p{{M}}*\p{{IsLatin}}")).select("row_id", "c.field")


@query("f_severed_name", "flat", sql=r"select row_id from flat where regexp_matches(answer_text, '[\p{Cyrillic}\p{Arabic}\p{Bengali}\p{Han}\p{Hiragana}\p{Katakana}]\pM*[a-z]{2,}|[a-z]{2,}[\p{Cyrillic}\p{Arabic}\p{Bengali}\p{Han}\p{Hiragana}\p{Katakana}]')")
def severed_name(flat):
    native = r"[\p{IsCyrillic}\p{IsArabic}\p{IsBengali}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    return flat.where(F.col("answer_text").rlike(rf"{native}\p{{M}}*[a-z]{{2,}}|[a-z]{{2,}}{native}")).select("row_id")


@query("f_dominant_script", "flat", sql=r"""select language, s as script, count(*) as n from (select language, case when greatest(a, b, c, d, e, f) = 0 then null when a = greatest(a, b, c, d, e, f) then 'arabic' when b = greatest(a, b, c, d, e, f) then 'bengali' when c = greatest(a, b, c, d, e, f) then 'cyrillic' when d = greatest(a, b, c, d, e, f) then 'han' when e = greatest(a, b, c, d, e, f) then 'kana' else 'latin' end as s from
 (select language, len(regexp_extract_all(answer_text, '\p{Arabic}')) a, len(regexp_extract_all(answer_text, '\p{Bengali}')) b, len(regexp_extract_all(answer_text, '\p{Cyrillic}')) c, len(regexp_extract_all(answer_text, '\p{Han}')) d, len(regexp_extract_all(answer_text, '[\p{Hiragana}\p{Katakana}]')) e, len(regexp_extract_all(answer_text, '\p{Latin}')) f from flat where answer_text is not null)) group by 1, 2""")
def dominant_script(flat):
    n = {k: v for k, v in T.script_counts(F.col("answer_text")).items() if k != "greek"}
    best = F.greatest(*n.values())
    s = F.when(best > 0, F.coalesce(*[F.when(n[k] == best, F.lit(k)) for k in sorted(n)]))
    return flat.where("answer_text is not null").groupBy("language", s.alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("f_option_integrity", "flat", sql="""select language, count(*) filter (where array_length(list_distinct([option_a, option_b, option_c, option_d])) < 4) as n_repeated,
 count(*) filter (where [option_a, option_b, option_c, option_d][answer_index + 1] is distinct from answer_text) as n_off from flat group by 1""")
def option_integrity(flat):
    o = F.array("option_a", "option_b", "option_c", "option_d")
    none = F.size(F.array_distinct(F.filter(o, lambda x: x.isNotNull()))) < 4
    return flat.groupBy("language").agg(F.count_if(none).alias("n_repeated"), F.count_if(~F.get(o, F.col("answer_index").cast("int")).eqNullSafe(F.col("answer_text"))).alias("n_off"))


@query("f_candidate_gate", "flat", sql=rf"""select language, reason, count(*) as n from (select language, case when question is null or trim(question, ' ') = '' then 'no question' when answer_text is null or trim(answer_text, ' ') = '' then 'no answer'
 when option_a is null or option_b is null or option_c is null or option_d is null then 'null option' when {LEAK} then 'leak' when answer_index is null then 'no index' when length(question) < 15 then 'short' else 'ok' end as reason from flat) group by 1, 2""")
def candidate_gate(flat):
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = F.when(blank("question"), "no question").when(blank("answer_text"), "no answer").when(F.col("option_a").isNull() | F.col("option_b").isNull() | F.col("option_c").isNull() | F.col("option_d").isNull(), "null option")
    reason = reason.when(T.leaks(F.col("answer_text"), F.col("question"), F.col("language")), "leak").when(F.col("answer_index").isNull(), "no index").when(F.length("question") < 15, "short").otherwise("ok")
    return flat.groupBy("language", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f_required_script_answer", "flat", sql=r"""select row_id from flat where answer_text is not null and not (case language when 'ru' then regexp_matches(answer_text, '\p{Cyrillic}') when 'ar' then regexp_matches(answer_text, '\p{Arabic}') when 'bn' then regexp_matches(answer_text, '\p{Bengali}')
 when 'ja' then regexp_matches(answer_text, '[\p{Hiragana}\p{Katakana}\p{Han}]') when 'zh' then regexp_matches(answer_text, '\p{Han}') else regexp_matches(answer_text, '\p{Latin}') end)""")
def required_script_answer(flat):
    """Answers without a letter of their language's script."""
    a, s = F.col("answer_text"), T.scripts()
    need = {"ru": s["cyrillic"], "ar": s["arabic"], "bn": s["bengali"], "ja": r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]", "zh": s["han"]}
    has = F.coalesce(*[F.when(F.col("language") == k, a.rlike(p)) for k, p in need.items()], a.rlike(s["latin"]))
    return flat.where(a.isNotNull() & ~has).select("row_id")


@query("f_length_bounds_answer", "flat", sql="select row_id from flat join (select language, avg(length(answer_text)) as m from flat group by 1) using (language) where length(answer_text) < 0.35 * m or length(answer_text) > 3 * m")
def length_bounds_answer(flat):
    m = flat.groupBy("language").agg(F.avg(F.length("answer_text")).alias("m"))  # a row a language
    n = F.length("answer_text")
    return flat.join(F.broadcast(m), "language").where((n < 0.35 * F.col("m")) | (n > 3 * F.col("m"))).select("row_id")


@query("f_length_bounds", "flat", sql="""select row_id from flat join (select language, avg(length(question)) as m from flat group by 1) using (language) where length(question) < 0.35 * m or length(question) > greatest(3 * m, length(subject) + 20)""")
def length_bounds(flat):
    m = flat.groupBy("language").agg(F.avg(F.length("question")).alias("m"))  # a row a language
    n = F.length("question")
    return flat.join(F.broadcast(m), "language").where((n < 0.35 * F.col("m")) | (n > F.greatest(3 * F.col("m"), F.length("subject") + 20))).select("row_id")


@query("f_stop_entities", "entity_labels", sql="select distinct lower(label) as entity from (select unnest(map_values(labels)) as label from entity_labels) where length(label) >= 4 and lower(label) not in ('music', 'film', 'book')")
def stop_entities(labels):
    e = F.lower("label")
    return labels.select(F.explode(F.map_values("labels")).alias("label")).where((F.length("label") >= 4) & ~e.isin("music", "film", "book")).select(e.alias("entity")).distinct()


@query("f_sentence_window", "documents", sql=r"select doc_id, trim(replace(text, chr(10), ' ')) as t from documents where length(trim(replace(text, chr(10), ' '))) between 20 and 600")
def sentence_window(documents):
    t = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    return documents.select("doc_id", t.alias("t")).where(F.length("t").between(20, 600))


@query("f_all_languages", "flat", sql="select fact_id, count(distinct language) as n from flat where fact_id is not null group by 1 having count(distinct language) filter (where language in ('en', 'de', 'fr')) = 3")
def all_languages(flat):
    three = F.countDistinct(F.when(F.col("language").isin("en", "de", "fr"), F.col("language")))
    return flat.where("fact_id is not null").groupBy("fact_id").agg(F.countDistinct("language").alias("n"), three.alias("three")).where("three = 3").drop("three")


@query("t_norm", "documents", sql=f"select doc_id, {NORM.format('text')} as t from documents")
def norm(documents):
    return documents.select("doc_id", T.norm(F.col("text")).alias("t"))


@query("t_norm_exact", "documents")
def norm_exact(documents):
    return documents.select("doc_id", T.norm_exact("text").alias("t"))


@query("t_squeeze", "flat", sql=r"select row_id, trim(regexp_replace(lower(question), '[ \t\n\v\f\r]+', ' ', 'g')) as t from flat")
def squeeze(flat):
    return flat.select("row_id", T.squeeze(F.col("question")).alias("t"))


@query("t_drop_punctuation", "flat", sql=r"select row_id, trim(regexp_replace(regexp_replace(lower(answer_text), '\pP+', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') as t from flat")
def drop_punctuation(flat):
    return flat.select("row_id", T.drop_punctuation(F.col("answer_text")).alias("t"))


@query("t_strip_edges", "flat", sql=r"select row_id, trim(regexp_replace(regexp_replace(lower(answer_text), '^[ \t\n\v\f\r.,;:!?。．]+|[ \t\n\v\f\r.,;:!?。．]+$', '', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'), ' ') as t from flat")
def strip_edges(flat):
    return flat.select("row_id", T.strip_edges(F.col("answer_text")).alias("t"))


@query("t_similarity", "flat", sql="select row_id, round(case when greatest(length(option_a), length(option_b)) = 0 then 1.0 else 1 - levenshtein(option_a, option_b)::double / greatest(length(option_a), length(option_b)) end, 6) as sim from flat where language = 'en' and option_a is not null and option_b is not null and option_a = regexp_replace(option_a, '[^ -~]', '', 'g')")
def similarity(flat):
    rows = flat.where("language = 'en' and option_a is not null and option_b is not null").where(F.col("option_a").rlike("^[ -~]*$"))
    return rows.select("row_id", F.round(T.similarity(F.col("option_a"), F.col("option_b")), 6).alias("sim"))


@query("t_similarity_all", "flat")
def similarity_all(flat):
    """Every row with both options, in any language and script; t_similarity is the part that its SQL covers."""
    rows = flat.where("option_a is not null and option_b is not null")
    return rows.select("row_id", F.round(T.similarity(F.col("option_a"), F.col("option_b")), 6).alias("sim"))


@query("t_best_label", "entity_labels", sql="select id, coalesce(nullif(labels['sw'], ''), nullif(labels['en'], ''), nullif(labels['fr'], ''), nullif(labels['de'], '')) as label from entity_labels")
def best_label(labels):
    return labels.select("id", F.coalesce(*[F.nullif(F.col("labels")[x], F.lit("")) for x in ("sw", "en", "fr", "de")]).alias("label"))


@query("t_template", "flat", sql="select template, count(*) as n from (select replace(question, subject, '[X]') as template from flat where language = 'en' and question is not null and subject <> '') group by 1")
def template(flat):
    rows = flat.where("language = 'en' and question is not null and subject <> ''")
    return rows.groupBy(T.template_of(F.col("question"), F.col("subject")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("t_prompt", "flat", sql="select row_id, 'Question: ' || question || chr(10) || 'A. ' || option_a || chr(10) || 'B. ' || option_b || chr(10) || 'C. ' || option_c || chr(10) || 'D. ' || option_d || chr(10) || 'Answer:' as prompt from flat")
def prompt(flat):
    lines = [F.concat(F.lit(f"{x}. "), F.col(f"option_{x.lower()}")) for x in "ABCD"]
    nl = F.lit("\n")
    return flat.select("row_id", F.concat(F.lit("Question: "), "question", nl, lines[0], nl, lines[1], nl, lines[2], nl, lines[3], nl, F.lit("Answer:")).alias("prompt"))


@query("t_is_correct", "flat", sql=f"""select row_id, coalesce(g <> '' and (p = g or contains(' ' || p || ' ', ' ' || g || ' ') or starts_with(p, g)), false) as correct from (select row_id, {NORM.format('answer_text')} as p, {NORM.format('object')} as g from flat)""")
def correct(flat):
    return flat.select("row_id", F.coalesce(T.is_correct(F.col("answer_text"), F.col("object")), F.lit(False)).alias("correct"))


_SQUEEZED = r"trim(regexp_replace(lower({}), '[ \t\n\v\f\r]+', ' ', 'g'))"
_ONLY = "case when {n} = 1 then case " + " ".join(f"when {{h{i}}} then '{x}'" for i, x in enumerate("ABCD")) + " end end"


def _only(hit: str) -> str:
    hits = [f"coalesce({hit.format(o=f'o{i}')}, false)" for i in range(4)]
    return _ONLY.format(n=" + ".join(f"({h})::int" for h in hits), **{f"h{i}": h for i, h in enumerate(hits)})


@query("t_answer_letter", "flat", sql=f"""select row_id, coalesce(case when p = o0 then 'A' when p = o1 then 'B' when p = o2 then 'C' when p = o3 then 'D' end, {_only("length({o}) > 0 and contains(p, {o})")}, {_only("length(p) >= 3 and contains({o}, p)")}) as letter
 from (select row_id, {_SQUEEZED.format('answer_text')} as p, {", ".join(_SQUEEZED.format(f"option_{x}") + f" as o{i}" for i, x in enumerate("abcd"))} from flat)""")
def answer_letter(flat):
    """The option that an answer means by its text; a mere letter resolves to none."""
    return flat.select("row_id", T.answer_letter(F.col("answer_text"), [F.col(f"option_{x}") for x in "abcd"], letters=False).alias("letter"))


@query("t_byte_length", "documents", sql="select lang, sum(greatest(1, strlen(text)))::bigint as bytes, sum(length(text) // 4)::bigint as est_tokens from documents where text is not null group by 1")
def byte_length(documents):
    return documents.where("text is not null").groupBy("lang").agg(F.sum(F.greatest(F.lit(1), F.octet_length("text"))).alias("bytes"), F.sum(T.estimated_tokens(F.col("text"))).alias("est_tokens"))


@query("t_ngrams", "eval_items", sql=rf"""with t as (select item_id, string_split({NORM.format('passage')}, ' ') as w from eval_items where lang not in ('ja', 'zh'))
 select item_id, count(distinct array_to_string(w[i:i + 7], ' ')) as n from (select item_id, w, unnest(range(1, len(w) - 6)) as i from t) group by 1""")
def ngrams(items):
    w = items.where("lang not in ('ja', 'zh')").select("item_id", F.split(T.norm(F.col("passage")), " ").alias("w"))
    return w.select("item_id", F.explode(T.ngrams(F.col("w"), 8)).alias("g")).groupBy("item_id").agg(F.countDistinct("g").alias("n"))


@query("t_first_line", "documents", sql=r"select doc_id, trim(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '')[1]) as line from documents")
def first_line(documents):
    return documents.select("doc_id", T.first_line(F.col("text")).alias("line"))


@query("t_json_object", "events", sql=r"select event_id, nullif(regexp_extract('x ' || props || ' y', '\{.*\}', 0), '') as obj from events")
def json_object(events):
    return events.select("event_id", T.json_object(F.concat(F.lit("x "), "props", F.lit(" y"))).alias("obj"))


@query("t_first_replaced", "flat", sql="select row_id, regexp_replace(option_b, 'Republic', 'Rep.') as t from flat where language = 'en'")
def first_replaced(flat):
    return flat.where("language = 'en'").select("row_id", T.first_replaced(F.col("option_b"), "Republic", "Rep.").alias("t"))


@query("t_language_codes", "documents", sql="select case split_part(split_part(lower(lang), '-', 1), '_', 1) when 'eng' then 'en' when 'deu' then 'de' when 'fra' then 'fr' when 'spa' then 'es' when 'por' then 'pt' else split_part(split_part(lower(lang), '-', 1), '_', 1) end as code, count(*) as n from documents group by 1")
def language_codes(documents):
    base = F.split_part(F.split_part(F.lower("lang"), F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in (("eng", "en"), ("deu", "de"), ("fra", "fr"), ("spa", "es"), ("por", "pt")) for x in pair])
    return documents.groupBy(F.coalesce(known[base], base).alias("code")).agg(F.count(F.lit(1)).alias("n"))
