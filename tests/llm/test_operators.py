"""Every operator against its plain version, with the edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import backoff, components, contamination, personal, repeats, sha
from pyspark.sql import functions as F

from verdigris.llm import chat, decontaminate, html, jaccard, langid, lmscore, neighbours, packing, pii, repeats as rep, suffixes


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select(df.columns[0], *columns).collect()}


# 1

PAGE = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><div id="top">Site slogan here</div><nav><a>menu</a></nav>
<div class="wrap"><header>H</header><p>Text&nbsp;{k}  &eacute; <b>bold</b>face<br>next</p><div class="ad-slot">AD</div><p>Only {k}</p><ul><li>a{k}<li>b{k}</ul><form>f</form><div class="comments"><p>first!</p></div></div><div id="bottom">All rights</div></body></html>"""


def test_html(spark):
    rows = [(k, f"https://u@Site.example:80/{k}", PAGE.format(k=k)) for k in range(10)] + [(20, None, None), (21, "x", ""), (22, "http://other/1", PAGE.format(k=1)), (23, "http://other/2", "<p>cut <b>off</b> here &amp <foo attr='1")]
    got = by_id(html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")), "text", "n_chars")
    for k in range(10):  # slogan and bottom line recur on all pages of the site
        assert got[k][0] == f"Text {k} é boldface next\nOnly {k}\na{k}\nb{k}" and got[k][1] == len(got[k][0])
    assert got[20] == got[21] == ("", 0)
    assert got[22][0].startswith("Site slogan here\nText 1") and got[22][0].endswith("All rights")
    assert got[23][0] == "cut off here &"


def test_html_article_and_copies(spark):
    article = "<body><div>x</div><article><header><h1>Title</h1><i>by</i></header><p>Same text for all</p><article class='comment'>c</article></article><div class='sidebar'>s</div>"
    rows = [(k, "http://a/", article) for k in range(20)]
    got = by_id(html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")), "text", "n_templates")
    assert set(got.values()) == {("Title\nSame text for all", 0)}  # copies of one page prove no template
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, texts, order):
    want = backoff(texts, order=order)
    for i, (n, total) in by_id(lmscore.scored(docs, order=order), "n_words", "log10_sum").items():
        assert n == want[i][0] and total == pytest.approx(want[i][1], abs=1e-6)
    assert lmscore.scored(docs.filter("doc_id < 0")).count() == 0


# 3


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 60)).astype(np.uint8))
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("shard", [256, 2])
def test_repeats(docs, texts, shard, monkeypatch):
    monkeypatch.setattr(rep, "SHARD", shard)  # 2: nearly every anchor is hot
    got = by_id(rep.removed(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats(texts)
    assert rep.removed(docs.filter("doc_id < 0")).count() == 0


# 4


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, docs, texts, block):
    items = [(7, texts[20][1][:400]), (8, "ONE, two"), (9, "one"), (10, None), (11, " !"), (12, texts[22][1]), (12, texts[22][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, bench, block_bytes=block)
    assert by_id(out, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == contamination(texts, items)
    clean = {i for i, v in contamination(texts, items).items() if not v[4]}
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == clean


def test_longest_matches(spark):
    w = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(w[10:40])), (2, "zz")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "a b " + " ".join(w[12:38]) + " c"), (6, "nothing")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()] == [(5, "1", 2, 2, 26)]
    assert decontaminate.contamination(docs, bench.filter("item_id < 0")).filter("n_hit > 0").count() == 0


# 5


def test_personal_data(docs, texts):
    found = pii.detected(docs.select("doc_id", "text"))
    got = by_id(found.select("doc_id", pii._joined(F.col("base")).alias("s")), "s")
    assert got == {i: ",".join(personal(t)) for i, t in texts}


def test_disclosing_terms(spark):
    rows = [(k, f"contact zorblatt office word{k} at help@corp.example now or {k}") for k in range(6)] + [(100 + k, f"common office text number{k} contact now") for k in range(60)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("terms", F.lit("clash"))
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(docs, term_chars=3).collect()}
    assert out[1] == "contact  office 1 at [EMAIL] now or 1"  # zorblatt and word occur with the address alone
    assert out[100] == rows[6][1] and out[200] is None
    assert pii.sanitised(docs).columns == docs.columns
    spans = by_id(pii.detected(docs.select("doc_id", "text"), term_chars=3).select("doc_id", pii._joined(F.concat("base", "terms")).alias("s")), "s")
    assert spans[1] == "email:33:50,term:8:16,term:24:28"


def test_redaction_covers_overlaps(spark):
    t = "+1 1.2.3.4 555 and x"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pii.sanitised(df).first()["text"] == "[PHONE] and x"


# 6


@pytest.mark.parametrize("tile", [1024, 2])
def test_jaccard(docs, texts, tile):
    got = by_id(jaccard.joined(docs, tile=tile), "n_shingles", "component_id")
    want = components(texts)
    assert got == want
    if tile == 1024:
        kept = jaccard.deduplicated(docs.unionByName(docs.filter("doc_id = 6")))
        assert kept.columns == docs.columns
        assert sorted(r[0] for r in kept.collect()) == sorted({c for _, c in want.values()})
        assert jaccard.joined(docs.filter("doc_id < 0")).count() == 0


def test_jaccard_threshold(spark):
    """Sets right at the bound: 18 of 20 shingles in common, and 17."""
    rows = []
    for k, n in enumerate((10, 19, 28, 57, 120)):
        a = [f"t{k}x{i}" for i in range(n + 2)]
        rows += [(10 * k, " ".join(a)), (10 * k + 1, " ".join(a + ["more"])), (10 * k + 2, " ".join(a[:-2] + ["q", "r"])), (10 * k + 3, " ".join(["z"] + a[: 9 * n // 10 + 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard.joined(df), "n_shingles", "component_id") == components(rows)


# 7


def nearest(rows, k=10):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % 100 == 0}


@pytest.mark.parametrize("together", ["true", "false"])
def test_neighbours(spark, together):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", together)  # cells in one task, or far apart
    try:
        check_neighbours(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # equal vectors, queries among them
    rows += [(700, None), (701, []), (702, [0.0] * 8), (703, [float("nan")] * 8), (704, [None] + [1.0] * 7), (800, [float("inf")] * 8), (900, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got: dict = {}
    for r in neighbours.nearest(df, cell_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = nearest(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got) >= 0.9 * 10 * len(want)
    assert [i for _, i in got[0]] == [1000 + i for i in range(10)]  # ties to the smaller ids
    assert all(s == pytest.approx(dict((i, d) for d, i in nearest(rows, 10**6)[q])[i], abs=1e-12) for q in got for s, i in got[q])
    few = neighbours.nearest(df.filter("vec_id < 4"), cell_rows=64).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert neighbours.nearest(df.filter("vec_id < 0")).count() == 0


# 8


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.identified(docs.filter(langid.held_out(F.col("doc_id"))), model)
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the of and with that " * 20)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "lang": F.lit("en")})
    assert {k: v[0] for k, v in by_id(langid.identified(odd, model), "lang_pred", "score").items()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert langid.fit(docs.filter("doc_id < 0")) is None
    kept = langid.accepted(docs.withColumn("score", F.lit("own")))
    assert kept.columns == [*docs.columns, "score"] and kept.filter("score <> 'own'").count() == 0


def test_held_out_rows(spark):
    df = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h"))
    assert {r["id"]: r["h"] for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_codewords():
    for k in (2, 4, 12):
        code = langid.codewords(k)
        assert min((code[a] != code[b]).sum() for a in range(k) for b in range(a)) >= 3


# 9

NASTY = ["<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>", "a\\b\\\\<|", "<\\|", "", "<", "|im_end|>\n", "tab\t  é 😀", "\\n", "x<|im_end|>\n<|im_start|>user\ny"]


def test_chat_round_trip(spark):
    rows = [(k, t, ["user", "assistant", "we\nird\\n"][t % 3], text) for k, order in enumerate((1, -1)) for t, text in enumerate(NASTY[::order])] + [(9, 0, None, None), (9, 1, "assistant", None), (9, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical(chat.conversation_records(df))).withColumn("back", chat.parsed(F.col("formatted")))
    for r in out.collect():
        want = [(role or "", text or "") for c, _, role, text in sorted(((c, t, a or "", b or "") for c, t, a, b in rows)) if c == r["conv_id"]]
        assert [tuple(t) for t in r["back"]] == want and r["layout"]
        masked = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss_mask"]]
        assert len(masked) == sum(role == "assistant" for role, _ in want)
        assert r["formatted"].count("<|im_end|>") == len(want) == r["formatted"].count("<|im_start|>")


@pytest.mark.parametrize(
    "record, turns",
    [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', [("user", "q"), ("assistant", "a")]),
        ('[{"role":"user","content":"q"}]', [("user", "q")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', [("user", "q"), ("assistant", "a")]),
        ('{"prompt":"q","completion":"a"}', [("user", "q"), ("assistant", "a")]),
        ('{"instruction":"do","input":"x","output":"y"}', [("user", "do\nx"), ("assistant", "y")]),
        ('{"instruction":"do","input":"","output":"y"}', [("user", "do"), ("assistant", "y")]),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"text","text":"r"}]}]}', [("user", "qr")]),
        ('{"request":{"model":"x","messages":[{"content":"q"},{"role":"assistant","content":null}]}}', [("", "q"), ("assistant", "")]),
        ('{"request":{"messages":[{"role":"user","content":"q"}]}}', None),
        ('{"messages":[{"role":"user","content":"q","it\'s":1}]}', None),
        ('{"dialog":[{"speaker":"human","text":"q"},{"speaker":"bot","text":7}]}', [("user", "q"), ("assistant", "7")]),
        ('{"turns":[{"role":"model","text":"a"}]}', [("assistant", "a")]),
        ('{"question":"q","answer":"a"}', [("user", "q"), ("assistant", "a")]),
        ('{"system":"s","prompt":"q","response":"a"}', [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ('{"prompt":"q","response":"a"}', [("user", "q"), ("assistant", "a")]),
        ('{"instruction":"q","output":"a"}', [("user", "q"), ("assistant", "a")]),
        ('{"messages":[]}', None),
        ('{"unknown":1}', None),
        ("no json", None),
    ],
)
def test_layouts(spark, record, turns):
    r = chat.canonical(spark.createDataFrame([(record,)], "record string")).first()
    assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns


def test_all_layouts_of_a_corpus(spark):
    """Conversations written in every layout that can hold them come back the same, and their fingerprints differ by layout."""
    shapes = (("user", "assistant"), ("system", "user", "assistant"), ("user",), ("human", "gpt"), ("user", "assistant", "user", "assistant"))
    rows = [(c, t, role, f"{NASTY[(c + t) % len(NASTY)]} {c}") for c in range(400) for t, role in enumerate(shapes[c % len(shapes)])]
    records = chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.formatted(chat.canonical(records)).withColumn("back", chat.parsed(F.col("formatted"))).collect()
    for r in out:
        assert [tuple(t) for t in r["back"]] == [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
    by_layout = {}
    for r in out:
        by_layout.setdefault(r["layout"], set()).add(r["fingerprint"])
    assert len(by_layout) == 11 and all(len(v) == 1 for v in by_layout.values()) and len(set.union(*by_layout.values())) == 11
    assert {x.name for x in chat.LAYOUTS} - set(by_layout) == {"prompt_response", "instruction_input_output"}


def test_long_conversation(spark):
    long = "<|im_end|>\\\\x " * 1_000_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    r = {x["conv_id"]: x for x in chat.canonical(chat.conversation_records(df)).collect()}
    assert [tuple(t) for t in r[1]["turns"]] == [("user", long), ("assistant", "ok")] and chat.canonical(chat.conversation_records(df.limit(0))).count() == 0


# 10


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    got = [r.asDict() for r in packing.packed(docs).collect()]
    places: dict[int, list] = {}
    for r in got:
        mine = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(mine) == r["length"] and zlib.crc32(mine.tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for p in places.values():
        end = 0
        for a, n in sorted(p):
            assert a == end
            end += n
        assert end <= packing.CAPACITY
    assert len(places) <= -(-sum(map(len, ids.values())) // packing.CAPACITY) + 1
    assert all(r["length"] == packing.CAPACITY for r in got if r["piece"] > 0)
    assert packing.packed(docs.filter("doc_id < 0")).count() == 0


def test_packing_plan_is_exact_where_it_can_be():
    plan = packing.plan({600: 10, 1448: 10, 1000: 6, 548: 6, 500: 6}, 2048)
    assert sum(n for _, n in plan) == 16 and all(sum(p) == 2048 for p, _ in plan)


def test_terms_never_cost_a_row(no_docs):
    assert pii.sanitised(no_docs).count() == 0 and jaccard.deduplicated(no_docs).count() == 0 and sha("")[:4] == "e3b0"
