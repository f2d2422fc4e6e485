"""Refusals that the opening clusters are to find, however short or unluckily placed."""

from lexiloom.llm import responses

FLAT = "row_id long, language string, question string, subject string, object string, option_a string, option_b string, option_c string, option_d string, answer_text string, answer_index long, option_ids array<string>, fact_id string, split string"


def test_short_refusals(spark):
    rows = []

    def add(language, answer, first):
        names = [f"{language} house {i}" for i in range(first, first + 4)]
        rows.append((len(rows), language, None, "Tom", names[0], *names, answer, 0, [f"Q{i}" for i in range(first, first + 4)], "k", "x"))

    for language, text in (("es", "No sé"), ("ru", "Не знаю"), ("sw", "Sijui"), ("en", "No idea"), ("zh", "我不知道"), ("en", "我不知道呢")):
        for first in (1, 5, 9):
            add(language, text, first)
    refused = set(range(len(rows)))
    for _ in range(3):
        add("en", "Zorbex", 1)  # a name that isn't known recurs with its entity
    add("en", "Quux", 5)  # and what occurs once is no template
    labels = spark.createDataFrame([("Q99", {"en": "Elsewhere"})], "id string, labels map<string,string>")
    found = responses.response_defects(spark.createDataFrame(rows, FLAT), labels).where("field_name = 'answer_text' and defect = 'refusal'")
    assert {r.row_id for r in found.collect()} == refused


def test_openings_of_a_crowded_band_all_meet(spark, monkeypatch):
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "omega", "sigma", "theta"]
    texts = [f"{a} {b} {c} will not say" for a in words for b in words[:4] for c in ("north", "south")]
    texts += [f"{t}s" for t in texts[::3]] + ["a", "b"]
    band = responses.minhash(responses._shingles("one band"))[:1]
    monkeypatch.setattr(responses, "minhash", lambda shingles: band)  # chance brings all into one band
    alike = [(a, b) for a in texts for b in texts if a < b and responses._alike(a, b)]
    root = {t: t for t in texts}
    for _ in texts:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    openings = spark.createDataFrame([(t,) for t in texts], "opening string")
    got = {r.opening: r.cluster for r in responses.opening_clusters(openings).collect()}
    assert len(alike) > 20 and {(a, b) for a in texts for b in texts if got[a] == got[b]} == {(a, b) for a in texts for b in texts if root[a] == root[b]}


def test_prefixes_lose_no_pair():
    words = ["no sé", "no se", "no lo sé", "i can not say that", "i can not say this", "i cannot say that", "我不知道", "我不知道呢", "не знаю", "a", ""]
    sets = {w: responses._shingles(w) for w in words}
    assert all(set(responses.prefix(sets[a])) & set(responses.prefix(sets[b])) for a in words[:-1] for b in words[:-1] if responses._alike(a, b))
