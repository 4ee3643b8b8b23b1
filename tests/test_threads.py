import functools
import random

from sentipanel.operators import threads as TH
from tests.model_tagging import tag_text

TERMS = {"AAA": "AAA", "BBB": "BBB", "Acme": "AAA"}


def _dominant(text, start):
    sizes = {}
    for t, x in tag_text(text, start, TERMS):
        if t:
            sizes[t] = sizes.get(t, 0) + len(x.encode())
    best = [t for t, s in sizes.items() if s > 0 and s == max(sizes.values())]
    return min(best) if best else ""


def test_propagation_rules(spark):
    posts = spark.createDataFrame([("p1", "\nAcme news"), ("p2", "\nnothing here")], "id string, text string")
    comments = spark.createDataFrame([
        ("c1", "p1", 10, "I agree fully"),          # inherits AAA from the post
        ("c2", "c1", 20, "BBB is better than BBB"),  # mention of BBB: AAA lead 0 bytes -> BBB
        ("c3", "c2", 30, "ok"),                      # inherits BBB
        ("c4", "c9", 40, "orphan AAA"),              # missing parent -> '' start
        ("c5", "c6", 5, "reply earlier than parent"),  # parent later -> ''
        ("c6", "p2", 50, "BBB"),
        ("c7", "p1", 60, ""),                        # empty text -> ''
    ], "id string, parent_id string, dt long, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    res = {r["id"]: (r["start_ticker"], r["dominant"]) for r in TH.propagate_thread_ticker(posts, comments, terms).collect()}
    assert res["c1"] == ("AAA", "AAA")
    assert res["c2"] == ("AAA", _dominant("BBB is better than BBB", "AAA"))
    assert res["c3"] == (res["c2"][1], res["c2"][1])
    assert res["c4"] == ("", "AAA")
    assert res["c5"] == ("", "")
    assert res["c6"] == ("", "BBB")
    assert res["c7"] == ("AAA", "")


def test_profile_equals_retagging(spark):
    import random
    rnd = random.Random(3)
    words = ["AAA", "BBB", "Acme", "x", "yy", " ", "(", ".", "\n", "é"]
    texts = ["".join(rnd.choice(words) + " " for _ in range(rnd.randint(0, 8))) for _ in range(150)]
    starts = ["", "AAA", "BBB", "CCC"]
    c = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    prof = TH.comment_profiles(c, terms)
    from pyspark.sql import functions as F
    for s in starts:
        got = {r["id"]: r["d"] for r in prof.select("id", TH.dominant_under_start(
            F.col("sizes"), F.col("t_first"), F.col("lead_bytes"), F.col("n_bytes"), F.lit(s)).alias("d")).collect()}
        for i, t in enumerate(texts):
            assert got[str(i)] == _dominant(t, s), (t, s)


def test_repeated_ids_and_a_long_chain(spark):
    """One row per comment row; an id that repeats stands for its last row; no level is cut off."""
    rows = [(f"c{i}", "p1" if i == 0 else f"c{i - 1}", i, "ok") for i in range(12) for _ in range(2)]
    rows.append(("c3", "c2", 99, "BBB"))  # the last row of c3 comes after its replies: they start from nothing
    posts = spark.createDataFrame([("p1", "Acme"), ("p1", "Acme"), ("p2", "x")], "id string, text string")
    comments = spark.createDataFrame(rows, "id string, parent_id string, dt long, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    got = TH.propagate_thread_ticker(posts, comments, terms).collect()
    assert len(got) == len(rows)
    by = {(r["id"], r["start_ticker"], r["dominant"]) for r in got}
    assert by == {(f"c{i}", "AAA", "AAA") for i in range(3)} | {("c3", "AAA", "BBB")} | {(f"c{i}", "", "") for i in range(4, 12)}


def _profile(text):
    segs = tag_text(text, "\x00", TERMS)
    lead = segs[0][1] if segs and segs[0][0] == "\x00" else ""
    segs = [x for x in segs if x[0] != "\x00"]
    sizes = {}
    for t, x in segs:
        sizes[t] = sizes.get(t, 0) + len(x.encode())
    if segs:
        sizes[segs[0][0]] += len(lead.encode())
    return sizes, segs[0][0] if segs else None, len(lead.encode()), len(text.encode())


def test_rules_equal_tagging_and_compose():
    rnd = random.Random(9)
    words = ["AAA", "BBB", "Acme", "x", "yy", "yyy", "(", "é"]
    texts = ["".join(rnd.choice(words) + " " for _ in range(rnd.randint(0, 5))) for _ in range(400)] + ["yyy AAA", "yyyyyyyyyy BBB AAA"]
    starts = ["", "A", "AAA", "AAB", "BBB", "BBBB", "C", "é", "\x00"]
    rules = []
    for t in texts:
        rules.append(TH.rule_of(*_profile(t)))
        for s in starts:
            assert TH.value_at(rules[-1], s) == _dominant(t, s), (t, s)
    for _ in range(300):
        chain = [rnd.choice(rules) for _ in range(rnd.randint(2, 7))]
        at = rnd.randrange(1, len(chain))
        fold = lambda rs: functools.reduce(lambda a, b: TH.composed(b, a), rs)
        both = TH.composed(fold(chain[at:]), fold(chain[:at]))  # composed in any grouping
        for s in starts:
            want = s
            for r in chain:
                want = TH.value_at(r, want)
            assert TH.value_at(both, s) == want


def test_a_chain_of_5000_in_log_rounds(spark):
    rnd = random.Random(2)
    texts = ["ok", "yyyyyyyy AAA", "BBB yes", "yy BBB", "", "no idea", "yyy AAA"]
    own = [rnd.choice(texts[:1] * 40 + texts) for _ in range(5000)]
    rules = spark.createDataFrame([(i, i - 1 if i else None, None if i else "AAA", *_profile(t)) for i, t in enumerate(own)],
                                  "id long, ptr long, known string, sizes map<string,bigint>, t_first string, lead_bytes long, n_bytes long")
    dominant, rounds = TH.pointer_double(TH._with_rules(rules))
    got = {r["id"]: r["dominant"] for r in dominant.collect()}
    want = {0: "AAA"}
    for i in range(1, 5000):
        want[i] = _dominant(own[i], want[i - 1])
    assert got == want and rounds <= 15


def test_comments_are_matched_once(spark, monkeypatch):
    """Segments follow from the stored profile; only rows of a repeated id with another text are matched on their own."""
    posts = spark.createDataFrame([("p1", "Acme")], "id string, text string")
    rows = [("c1", "p1", "p1", 1, "yes BBB no"), ("c2", "c1", "p1", 2, None), ("c2", "c1", "p1", 3, "see Acme, ok"), (None, "c2", "p1", 4, "BBB")]
    comments = spark.createDataFrame(rows, "id string, parent_id string, post_id string, dt long, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    got = sorted((str(r["id"]), r["seg"], r["ticker"], r["text"], r["start_ticker"] or "") for r in TH.tag_comments(posts, comments, terms).collect())
    start = {"c1": "AAA", "c2": _dominant("yes BBB no", "AAA"), "None": ""}
    want = sorted((str(i), k, t, x, start[str(i)]) for i, _, _, _, text in rows for k, (t, x) in enumerate(tag_text(text or "", start[str(i)], TERMS)) if t)
    assert got == want
