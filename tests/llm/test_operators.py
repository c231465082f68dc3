"""The operators of the llm subpackage against brute force, round trips and held-out accuracy, and on odd rows."""
from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlake.llm import common, html, language, leaks, lines, near, neighbours, packing, personal, rangecoder, secrets, token_output, tokens
from claimlake.llm.components import components
from claimlake.llm.queries import ORACLE, QUERIES
from tests.compare import connect, difference

TEXTS = [None, "", " \n ", "one two", "one two", "A b c d e f g. " * 3000, "x" * 50_000, "the same line\nthe same line", "ß İI ΑΣ É́ <|endoftext|> \x01 \x1c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null and a repeated doc_id, columns whose names clash."""
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, 7, "n") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id here now and then some", None, None, None, None, None, None), (1, "other text of one", "de", "s", 1, 1.0, 1, "")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) == ""


def union_find(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (500, 499), (500, 499)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in [100, *range(200, 250)]}, 499: 499, 500: 499}


# 1: HTML
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad-7">Buy, now</div>
<div class="post post-%d"><h1>Head &amp; line</h1><p>First  <b>bold</b>
text, with commas, and more words here<br>next<p>Second &eacute; &#8217; block, which is long enough to count<ul><li>one, two<li>three</ul></div>
<div id="comments"><p>A reader, says, something, long, here</p></div><script>var a="<p>no</p>"</script><footer>Foot</footer></body></html>"""


def test_html_blocks_and_consensus(spark, empty):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(4)] + [(9, None, None), (10, None, "plain &lt;text"), (11, "http://h.example/x", "<p>a<p"), (12, "u", "<div" * 500 + '<a title="x>y')]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Head & line\n\nFirst bold text, with commas, and more words here next\n\nSecond é ’ block, which is long enough to count\n\none, two\n\nthree"
    assert all(got[i]["text"] == text and got[i]["n_chars"] == len(text) for i in range(4))
    assert (got[9]["text"], got[10]["text"], got[11]["text"]) == ("", "plain <text", "a")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_votes_outweigh_an_odd_page(spark):
    odd = '<body><div class="post"><p>short, own, text</p></div><div class="promos"><p>' + "long, list, of, other, things, " * 30 + "</p></div></body>"
    usual = '<body><div class="post"><p>' + "article, text, here, " * 30 + "</p></div></body>"
    rows = [(i, "http://h/", usual) for i in range(5)] + [(5, "http://h/", odd)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "short, own, text"


WORDS = "some, words, of, a, part, of, the, text, "
WHOLE = f"""<body><div class="menu2"><a href=x>{WORDS}</a></div><%s><h1>Title</h1><p>intro</p><section class="a"><p>{WORDS * 20}</p></section><section class="b"><p>{WORDS * 20}</p></section>
<table><tr><td>{WORDS * 30}</td><td>cell</td></tr></table><blockquote><p>{WORDS * 40}</p></blockquote><div class="x"><p>{WORDS * 20}</p></div><p>closing</p></%s></body>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_text_around_inner_containers(spark, tag):
    rows = [(i, "http://h/", WHOLE % (tag, tag)) for i in range(3)] + [(3, None, WHOLE % (tag, tag))]
    rows += [(i, "http://g/", f"<body><{tag}><div class=x><p>{WORDS * 20}</p></div></{tag}></body>") for i in range(4, 9)] + [(9, "http://g/", f"<body><{tag}><p>intro</p><div class=x><p>{WORDS * 20}</p></div></{tag}></body>")]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    block = lambda n: (WORDS * n).strip()
    assert all(got[i] == ["Title", "intro", block(20), block(20), block(30), "cell", block(40), block(20), "closing"] for i in range(4))
    assert got[4] == [block(20)] and got[9] == ["intro", block(20)]


def test_html_sections_of_a_body_and_layout_cells():
    page = html.Page(f"<body><h1>Title</h1><section class=a><p>{WORDS * 20}</p></section><section class=b><p>{WORDS * 20}</p></section></body>")
    assert page.text(page.scores()[0][1]).startswith("Title\n\n")
    page = html.Page(f"<body><table><tr><td class=l><a href=x>{WORDS * 5}</a></td><td class=r><p>{WORDS * 20}</p></td></tr></table></body>")
    assert page.text(page.scores()[0][1]) == (WORDS * 20).strip()


ARTICLE = f"<h1>Title</h1><p>{WORDS * 8}</p><p>{WORDS * 5}</p>"
SIDE = '<div class="sidebar"><p>Read this too, dear reader.</p></div>'


@pytest.mark.parametrize("page", [
    f'<body><div class="site has-sidebar">{ARTICLE}{SIDE}</div></body>', f'<body><div id="nav-wrapper-content">{ARTICLE}{SIDE}</div></body>',
    f'<body><div class="ad-free">{ARTICLE}</div>{SIDE}</body>', f'<body><form id="aspnetForm"><input type=hidden>{ARTICLE}{SIDE}</form></body>',
    f'<body><article><div class="entry-header"><h1>Title</h1></div><p>{WORDS * 8}</p><p>{WORDS * 5}</p></article>{SIDE}</body>',
    f'<body><article>{ARTICLE}</article><div id="comments"><h3>Said</h3><p>{WORDS * 40}</p></div></body>',
    f'<body><article>{ARTICLE}<form><p>Your mail, please</p><input><button>Go</button></form></article></body>'])
def test_html_words_are_evidence_only(page):
    assert html.main_text(page).split("\n\n") == ["Title", (WORDS * 8).strip(), (WORDS * 5).strip()]


def test_html_keeps_what_the_host_votes_for():
    page = f'<body><div class="widget"><p>{WORDS}</p></div><div class="b"><p>{WORDS * 9}</p></div></body>'
    assert html.main_text(page, "/body/div.widget") == WORDS.strip()
    assert html.main_text(page) == html.main_text(page, "/body/div.none") == (WORDS * 9).strip()


@pytest.mark.parametrize("tag", ["font", "div", "p><b", "b></i"])
def test_html_deep_pages_take_linear_time(tag):
    def seconds(n):
        begin = time.process_time()
        assert html.main_text("<body>" + f"<{tag}>x y" * n)
        return time.process_time() - begin
    seconds(2_000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_html_odd_rows(spark):
    rows = [(1, "http://h/", PAGE % 1, "x", "y")] * 2 + [(None, None, "<p>a, b", None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string")).collect()
    assert len(got) == 3 and got[0]["text"] and len({r["text"] for r in got}) == 2


# 2: token output
@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535) | st.integers(0, 5), max_size=9000))
def test_range_coder_round_trip(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, np.uint16))).tolist() == ids


def test_range_coder_tells_damage():
    packed = bytearray(rangecoder.encode(np.arange(5000, dtype=np.uint16) % 50))
    packed[-2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rangecoder.decode(bytes(packed))
    assert len(packed) < 5000


def ids_of(text):
    encoder = tokens.encoder(tokens.vocabulary())
    return [*encoder.library.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_token_output_round_trip(spark, odd, empty, tmp_path):
    token_output.write_tokens(odd, str(tmp_path / "a"), frame_ids=500)
    got = token_output.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in got) == sorted((r["doc_id"] or -1, tuple(ids_of(r["text"]))) for r in odd.collect())
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda d: -1 if d is None else d)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    token_output.write_tokens(empty, str(tmp_path / "b"))
    assert token_output.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_encoder_equals_the_library(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + TEXTS
    encoder = tokens.encoder(tokens.vocabulary())
    assert [np.frombuffer(p, encoder.dtype).tolist() for p in encoder.encode(texts)] == [ids_of(t) for t in texts]


def test_encoder_meets_new_words_once(monkeypatch):
    """Words of letters go without the normalizer, in one piece each, and have the library's ids; portions leave no text out."""
    rng, letters = np.random.default_rng(7), list("abcdeéßñçÿœǆɐʼ'ªº")
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 40)).replace(" ", ", ", 5) for _ in range(300)] + ["", None, "İI Éa\r\nb\u2003c", "a" * 3000]
    encoder = tokens.Encoder(tokens.vocabulary())
    asked = []
    whole = encoder._chunks
    monkeypatch.setattr(encoder, "_chunks", lambda chunks: asked.extend(chunks) or whole(chunks))
    assert [np.frombuffer(p, encoder.dtype).tolist() for p in encoder.encode(texts)] == [ids_of(t) for t in texts]
    assert asked and not any(c.isalpha() for c in asked)
    monkeypatch.setattr(tokens, "PORTION", 500)
    runs = list(tokens.portions(pa.array(texts)))
    assert [k for a, b in runs for k in range(a, b)] == list(range(len(texts))) and len(runs) > 50 and list(tokens.portions(pa.array([], pa.string()))) == []


def test_encoder_keeps_few_chunks(monkeypatch):
    """The chunks kept are bounded by MEMORY and one portion, those met last are among them, and the ids stay the library's."""
    monkeypatch.setattr(tokens, "MEMORY", 400)
    encoder, held = tokens.Encoder(tokens.vocabulary()), []
    for k in range(30):
        texts = [f"often {k * 50 + j}x some{j}" for j in range(50)]
        assert [np.frombuffer(p, encoder.dtype).tolist() for p in encoder.encode(texts)] == [ids_of(t) for t in texts]
        held.append(len({**encoder.known, **encoder.older}))
    assert max(held) <= 800 and "often" in encoder.known and encoder.older


# 3: lines
def line_groups(texts: list[str]) -> list[int]:
    sets = [{t[i:i + lines.SHINGLE] for i in range(max(1, len(t) - lines.SHINGLE + 1))} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return union_find(len(texts), links)


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    base = [" ".join(rng.choice(words, 30)) for _ in range(30)]
    many = [b + f" {k}" for b in base for k in range(4)] + base + [base[0].replace(" ", "  ", k) for k in range(60)] + ["ab", "ab", "é" * 12, "𝄞" * 30]
    rng.shuffle(many)
    docs = [(k, "\n".join(many[k:k + 3])) for k in range(0, len(many), 3)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = [x for _, t in docs for x in t.split("\n")]
    first, stay = set(), []
    for line, group in zip(order, line_groups(order)):
        if group not in first:
            stay.append(line)
        first.add(group)
    assert sorted(x for r in got for x in r["text"].split("\n") if x) == sorted(stay)
    assert sum(r["n_kept"] for r in got) == len(stay)


def test_lines_that_repeat_a_passage(spark):
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 2000))
    texts = [passage * 50, passage * 60, passage * 60 + "!", "-" * 400, "-" * 5000, "other words of a line that is like none of them"]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["n_kept"]) == [0, 3, 5]


def test_lines_of_usual_length_with_an_edit(spark):
    base = ["Posted on 2024-01-17 by the editors of the page, number 1", "All rights are reserved by the owner of this site, whose terms of service apply to all of its users",
            "This other line is like neither of them, nor is it edited"]
    docs = list(enumerate([*base, base[0].replace("17", "18"), base[1].replace("owner", "person")]))
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["n_kept"]) == [0, 1, 2]


def test_mixed_groups_are_met_some_bands_at_a_time(spark, monkeypatch):
    """The rows of mixed groups, which take most disk, come in as many tables as the bands are dealt in."""
    rng, seen = np.random.default_rng(5), []
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 12))) for k in range(400)], "doc_id long, text string")
    mixed = lines._mixed
    monkeypatch.setattr(lines, "_mixed", lambda rows, *a: seen.append(rows.count()) or mixed(rows, *a))
    lines.dedup_lines(docs).collect()
    parts = -(-lines.BANDS // lines.PORTION)
    assert len(seen) >= parts and min(seen[:parts]) > 0 and max(seen[:parts]) < 0.6 * sum(seen[:parts])


def test_splits_keep_similar_lines_together(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(400):
        own = "".join(rng.choice(list("abcdefghijklmnop"), 200))
        texts += [own, own[:-27] + "".join(rng.choice(list("qrstuvwxyz"), 27))]
    assert all(0.75 <= len(a & b) / len(a | b) <= 0.78 for a, b in ((set(lines.shingle_hashes([t])[0].tolist()) for t in texts[k:k + 2]) for k in range(0, 800, 2)))
    docs = lines.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    signed, names = lines.signatures(docs).cache(), {r["id"]: r["doc_id"] for r in docs.collect()}
    whole = signed.selectExpr("0L band", "id", "rung")
    for keyed in [lines.bands(signed), *(lines._narrower(whole, signed, d) for d in range(lines.DEPTH))]:
        keys = defaultdict(set)
        for r in keyed.collect():
            keys[names[r["id"]]].add(r["band"])
        assert sum(keys[k].isdisjoint(keys[k + 1]) for k in range(0, 800, 2)) <= 3


def test_parities_leave_out_unlike_lines_only(spark):
    """Of pairs below 0.75 hardly one is left whose texts would have to meet; of those from 0.75 on none is missing."""
    rng, rows = np.random.default_rng(5), []
    for k in range(60):
        own = "".join(rng.choice(list("abcdefghijklmnop"), 400))
        rows += [(2 * k, own), (2 * k + 1, own[:400 - 3 * k] + "".join(rng.choice(list("qrstuvwxyz"), 3 * k)))]
    texts = spark.createDataFrame(rows, "id long, line string")
    pairs = spark.createDataFrame([(a, a - 1) for a in range(1, 120, 2)], "a long, b long")
    left = {r["a"] for r in lines._possible(pairs, lines.parities(texts), lines.LEAST).collect()}
    sets = [set(t[i:i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)) for _, t in rows]
    similar = {a for a in range(1, 120, 2) if 100 * len(sets[a] & sets[a - 1]) >= 75 * len(sets[a] | sets[a - 1])}
    assert similar <= left and 10 < len(similar) and len(left - similar) <= 6 and len(left) < 45


def test_lines_odd(odd, empty):
    got = lines.dedup_lines(odd).collect()
    assert len(got) == odd.count() and lines.dedup_lines(empty).count() == 0
    assert {(r["doc_id"], r["text"]) for r in got} >= {(0, None), (1, ""), (2, " \n "), (7, "the same line")}
    assert set(lines.dedup_lines(odd).columns) == {*odd.columns, "n_lines", "n_kept"}


def test_lines_leave_no_steps_behind(spark, monkeypatch, tmp_path):
    """On disk at the end of the steps: only what the rest of the job reads, no older step and no shuffle file of one (but a few of counts)."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    text = "\n".join(f"a line of some words that is like the other ones of this text, number {k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text.replace("words", "wards"))], "doc_id long, text string")
    before = blocks.getAllFiles().size()
    got = lines.dedup_lines(docs)
    assert blocks.getAllFiles().size() < before + 10
    assert len([f for f in tmp_path.iterdir() if f.name.startswith("stored-")]) == 2
    assert sum(r["n_kept"] for r in got.collect()) == 1


def test_pivots_find_all_that_are_like_another(monkeypatch):
    """Each row goes to the first of its group that is like it and no earlier pivot's; needed are the rows that are like another one."""
    rng = np.random.default_rng(6)
    groups = np.sort(np.concatenate([np.full(90, 0), rng.integers(1, 60, 260)]))
    groups = np.searchsorted(np.unique(groups), groups)
    bases = rng.integers(0, 256, (12, lines.HASHES), np.uint8)
    least = bases[rng.integers(0, 12, len(groups))]
    other = rng.random(least.shape) < rng.random((len(least), 1)) * 0.5
    least[other] = rng.integers(0, 256, other.sum(), np.uint8)
    sketches, most = lines._sketches(least), lines._most_different(lines.LEAST)
    like = np.array([[bool(lines._differing(sketches[[a]], sketches[[b]])[0] <= most) and groups[a] == groups[b] for b in range(len(groups))] for a in range(len(groups))])
    expected = []
    for k in range(len(groups)):
        expected.append(next((p for p in range(k) if expected[p] == p and like[p, k]), k))
    for together, pivots, looked in ((48, 4096, 1 << 24), (2, 4096, 1 << 24), (48, 4096, 0), (2, 4, 1 << 24)):
        for name, value in (("TOGETHER", together), ("PIVOTS", pivots), ("LOOKED", looked)):
            monkeypatch.setattr(lines, name, value)
        got, needed = lines._pivots(groups, sketches, most)
        alike = like.sum(axis=1) > 1
        assert 50 < alike.sum() < len(groups) - 20 and needed[alike].all()
        if pivots == 4096:
            assert got.tolist() == expected
        if pivots == 4096 and looked:
            assert needed.tolist() == alike.tolist()
    assert [x.tolist() for x in lines._pivots(groups[:0], sketches[:0], most)] == [[], []]


@pytest.fixture()
def unlike(spark):
    """200 lines around one passage, the first three of them similar and all others at about 0.6 to each other."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    passage = "".join(rng.choice(letters, 400))
    texts = [passage + "".join(rng.choice(letters, 130)) for _ in range(200)]
    texts[1:3] = [texts[0][:-10] + "".join(rng.choice(letters, 10)) for _ in range(2)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_unlike_lines_of_a_group_make_no_pairs(unlike, monkeypatch):
    """Lines that share a passage share bands, but of their pairs, which are as many as the square of their number, hardly any becomes a row."""
    made, linked = [], lines._linked
    monkeypatch.setattr(lines, "_linked", lambda pairs, *a: made.append(pairs.count()) or linked(pairs, *a))
    got = lines.dedup_lines(unlike).collect()
    assert sorted(r["doc_id"] for r in got if not r["n_kept"]) == [1, 2]
    assert sum(made) < 400


def test_pairs_across_components_in_portions(unlike, spark, monkeypatch):
    """However many rows a task holds at a time, and from whichever band, the same pairs come, each similar one among them."""
    signed, texts = lines.signatures(lines.lines_of(unlike)).drop("times").cache(), lines.lines_of(unlike)
    features = signed.join(lines.parities(texts), "id")
    ready = lines.bands(signed).join(features, ["id", "rung"]).selectExpr("*", "id comp").cache()
    ready = ready.join(ready.groupBy("band").agg({"id": "min"}).withColumnRenamed("min(id)", "main"), "band").cache()
    pairs = {}
    for held in (1 << 16, 500):
        monkeypatch.setattr(lines, "PACKED", held)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        try:
            for once in (False, True):
                rows = [(r["a"], r["b"]) for r in lines._across(ready, lines.LEAST, once).collect()]
                assert not once or len(rows) == len(set(rows))
                pairs[held, once] = set(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {r["doc_id"]: r["id"] for r in texts.collect()}
    similar = {(max(ids[a], ids[b]), min(ids[a], ids[b])) for a in range(3) for b in range(a)}
    assert len({frozenset(x) for x in pairs.values()}) == 1 and similar <= pairs[500, True]


def test_lines_that_come_again_without_any_like_them(spark):
    docs = [(1, "one line of the first text\nanother line, which comes again"), (2, "another line, which comes again\na third line"), (2, "another line, which comes again\na third line"), (None, "a third line")]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_kept"]) for r in got) == [(0, "a third line", 1, 1), (1, docs[0][1], 2, 2), (2, "", 2, 0), (2, "", 2, 0)]


# 4 and 5: scans
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
NOISE = st.text(alphabet="aAbpswordPTOKENsecrtik=:\"' 0123456789.+-()@_/\nKIA", max_size=200)


@settings(max_examples=200, deadline=None)
@given(NOISE)
def test_secret_patterns(text):
    expected = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert sorted(expected) == sorted(secrets.base_spans(text))


def test_entropy_windows():
    key = "q8Zr3LxV0tPw7NcY2mKd"
    assert [s[0] for s in secrets.entropy_spans(f"see {key} there", [])] == ["entropy_base64"]
    assert secrets.entropy_spans(f"see {key} there", [("assign", 0, 30)]) == []
    for plain in ("supercalifragilisticexpialidocious", "123e4567-e89b-12d3-a456-426614174000", "0123456789abcdefghijklmnop", "a1" * 30, "2024-01-02T030405Z-2024-01-03"):
        assert secrets.entropy_spans(plain, []) == [], plain
    assert secrets._windows(key * 2, 0, 40, 20, 3.8, 2, 4) == [(0, 40)]


def _entropy(piece):
    return -sum(piece.count(c) / len(piece) * math.log2(piece.count(c) / len(piece)) for c in set(piece))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab0179cdefZqK-+=", min_size=20, max_size=90))
def test_entropy_windows_equal_counting_each_anew(text):
    for _, characters, size, least, digits, letters in secrets.CLASSES:
        for run in re.finditer("[" + re.escape("".join(sorted(characters))) + "]+", text):
            hits = {i for at in range(run.start(), run.end() - size + 1) for i in range(at, at + size) if _entropy(text[at:at + size]) >= least - 1e-9
                    and sum(c.isdigit() for c in text[at:at + size]) >= digits and sum(c.isalpha() for c in text[at:at + size]) >= letters}
            assert {i for a, b in secrets._windows(text, run.start(), run.end(), size, least, digits, letters) for i in range(a, b)} == hits


def test_secrets_of_a_long_log_take_linear_time():
    def seconds(n):
        text = "".join(hashlib.sha256(str(i).encode()).hexdigest() + f"Zq{i % 10}\n" for i in range(n))
        begin = time.process_time()
        base = secrets.base_spans(text)
        assert len(base) == n and len(secrets.entropy_spans(text, base)) >= 0
        return time.process_time() - begin
    seconds(200)
    assert seconds(8_000) < 40 * max(seconds(800), 0.01)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab@.-+ ()0123456789\n", max_size=120))
def test_personal_patterns(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    expected = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    expected += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    expected += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and personal._luhn(digits(m))]
    expected += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    assert personal.base_spans(text) == expected


@pytest.fixture(scope="module")
def learned(spark, folder):
    return personal.learn(spark.read.parquet(f"{folder}/documents.parquet"))


FILL = "word " * 400


@pytest.mark.parametrize("text, added", [
    (f"Call +49 30 1234567 now. {FILL} Later 030 1234567 or 0301234567.", [("phone", "030 1234567"), ("phone", "0301234567")]),
    (f"+4930123456 {FILL} 4930123456 {FILL} 4930123456 {FILL} 4930123456", [("phone", "4930123456")] * 3),
    (f"pay 4111 1111 1111 1111 {FILL} then 4111-1111-1111-1112, in 2024", [("card", "4111-1111-1111-1112")]),
    (f"Jo@Example.org wrote. {FILL} jo@example said, not al@example", [("email", "jo@example")]),
    ("order 1234567 and order 1234567, a@b and a@b, 30 and 30 in 2024", []), ("+49 30 1234567 costs 30 in 2024, not 7654321", []), ("", [])])
def test_learned_field_labels_repeats(learned, text, added):
    base = personal.base_spans(text)
    assert [(kind, text[a:b]) for kind, a, b in personal.field_spans(text, base, learned)] == added


def _by_enumeration(field, weights):
    own, pairs, matrices = personal.potentials(field, weights)
    chances = np.zeros((len(own), personal.LABELS))
    for labels in itertools.product(range(personal.LABELS), repeat=len(own)):
        weight = math.exp(sum(own[k, m] for k, m in enumerate(labels)) + sum(k[labels[a], labels[b]] for (a, b), k in zip(pairs, matrices)))
        chances[np.arange(len(own)), labels] += weight
    return (chances / chances.sum(axis=1, keepdims=True))[:len(field.spans)]


@pytest.mark.parametrize("text, loops", [("1234567 word 1234567 word 8", False), ("77 88 word 99", False), ("12 a@b c@d", False),
                                         ("a@b.c word a@b word a@b", False), ("1234567 a@b 1234567", True), ("x1234567 123, 1234567 1234567", True)])
def test_messages_equal_enumeration(text, loops):
    rng = np.random.default_rng(5)
    for _ in range(3):
        chain = rng.normal(size=(personal.LABELS,) * 2)
        weights = (rng.normal(size=(personal.FEATURES, personal.LABELS)) / 3, (chain + chain.T) / 4, rng.normal(size=(personal.LABELS,) * 2) / 2 + np.eye(personal.LABELS))
        field = personal.Field(text, personal.base_spans(text))
        assert 0 < len(field.spans) + len(field.hubs) <= 6
        assert np.abs(_by_enumeration(field, weights) - personal.marginals(field, weights)).max() < (0.1 if loops else 1e-3)


def test_a_long_chain_of_repeats_is_one_hop(learned):
    text = f"+4930123456 {FILL}" + "".join(f"4930123456 {FILL}" for _ in range(300))
    assert len(personal.field_spans(text, personal.base_spans(text), learned)) == 300


def test_scans_odd(odd, empty):
    weights = personal.learn(empty)
    for scan in (secrets.find_secrets, lambda d: personal.find_personal(d, weights)):
        assert scan(odd).count() == odd.count() and scan(empty).count() == 0
        assert {r["spans"] for r in scan(odd).where("doc_id = 0").collect()} == {""}


# 6: near-duplicates
def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)]
    texts = []
    for k in range(12):
        base = list(rng.choice(words, 150))
        for _ in range(90 if k == 0 else 4):
            own = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 6)):
                own[at] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [texts[0]] * 5 + ["a b", "A  b", "", None]
    got = {r["doc_id"]: r for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [got[i]["component_id"] for i in range(len(texts))] == union_find(len(texts), links)
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_near_duplicates_leave_no_candidates_behind(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(2000)]
    base, texts = list(rng.choice(words, 150)), []
    for _ in range(60):
        own = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == union_find(60, links)
    assert not [f for f in tmp_path.iterdir() if spark.read.parquet(str(f)).columns == ["id", "doc_id"]]


def test_pairs_below_the_threshold_are_not_made(spark):
    """Parities leave out nearly all pairs of a group that lie below the threshold, and none that reach it."""
    rng, words = np.random.default_rng(8), [f"w{k}" for k in range(5000)]
    texts = []
    for k in range(80):
        own = list(rng.choice(words, 400))
        texts += [" ".join(own), " ".join(own[:400 - 2 * k] + list(rng.choice(words, 2 * k)))]
    sets = near.sets_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sets = sets.withColumnsRenamed({"n_shingles": "size"}).selectExpr("*", "doc_id div 2 node", "id comp").localCheckpoint()
    left = {frozenset(r) for r in near._pairs(sets, sets, ["node"], (85, 100)).collect()}
    ids = {r["doc_id"]: r["id"] for r in sets.collect()}
    full = [set(near.shingle_set(t).tolist()) for t in texts]
    similar = {frozenset((ids[k], ids[k + 1])) for k in range(0, 160, 2) if ids[k] != ids[k + 1] and 100 * len(full[k] & full[k + 1]) >= 85 * len(full[k] | full[k + 1])}
    assert similar <= left and len(similar) > 10 and len(left - similar) <= 4


def test_near_nodes_of_unlike_texts_do_not_branch(spark, monkeypatch):
    """Texts of one large group that reach the threshold with few others are met in its nodes, and no rows are made further down."""
    rng, words = np.random.default_rng(9), [f"w{k}" for k in range(5000)]
    base, texts, below = list(rng.choice(words, 300)), [], []
    for _ in range(80):
        own = list(base)
        for at in rng.choice(300, 15, replace=False):
            own[at] = rng.choice(words)
        texts += [" ".join(own), " ".join([*own[:-1], "end"])]
    nodes = near._nodes
    monkeypatch.setattr(near, "_nodes", lambda rows, trees, depth: (found := nodes(rows, trees, depth), trees or below.append(found.count()))[0])
    got = near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [set(near.shingle_set(t).tolist()) for t in texts]
    links = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == union_find(160, links)
    assert sum(below) == 0


def test_near_duplicates_odd(odd, empty):
    got = near.near_duplicates(odd).collect()
    assert len(got) == odd.count() and near.near_duplicates(empty).count() == 0
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] in (3, 4)} == {(3, 3), (4, 3)}


# 7: neighbours
def test_neighbours_recall_and_ties(spark, folder):
    from pyspark.sql import functions as F
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    twins = table.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 10_000)
    odd = spark.createDataFrame([(20_000, None), (20_020, []), (20_040, [0.0] * 64), (20_060, [float("nan")] * 64), (20_080, [None] * 64), (20_100, [1.0, 2.0]), (20_120, [2.0, 1.0])],
                                "vec_id long, embedding array<float>")
    rows = table.select("vec_id", "embedding").union(twins.select("vec_id", "embedding")).union(odd)
    got = defaultdict(list)
    for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows.where("size(embedding) = 64 and vec_id < 20000").collect()}
    ids, x = np.array(list(whole)), np.stack(list(whole.values()))
    hits = 0
    for q in [i for i in whole if i % 20 == 0]:
        score = x @ whole[q]
        best = sorted(((-round(s, 9), i) for s, i in zip(score, ids.tolist()) if i != q))[:20]
        assert len(got[q]) == 20 and all(abs(s - whole[q] @ whole[i]) < 1e-9 for i, s in got[q])
        assert [(-round(s, 9), i) for i, s in got[q]] == sorted((-round(s, 9), i) for i, s in got[q])
        hits += len({i for i, _ in got[q]} & {i for _, i in best})
    assert hits >= 0.9 * 20 * sum(i % 20 == 0 for i in whole)
    assert [i for i, _ in got[20_100]] in ([], [20_120]) and not set(got) & {20_000, 20_020, 20_040, 20_060, 20_080}
    assert neighbours.nearest(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 8: language
def test_language_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op8_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 0


def test_language_takes_few_rows_at_a_time(spark, folder, monkeypatch):
    """Texts become Python values a portion at a time and rows of the matrix are added up in parts, with the same result."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, "a long text of words " * 9000, "en")], "doc_id long, text string, lang string"))
    model = language.learn(docs)
    whole = sorted(language.classify(docs, *model).select("doc_id", "lang_pred", "score").collect())
    monkeypatch.setattr(language, "_ROWS", 100)
    monkeypatch.setattr(tokens, "PORTION", 5000)
    column = pa.array([r["text"] for r in docs.collect()])
    runs = list(tokens.portions(column))
    assert len(runs) > 10 and list(language._texts(pa.record_batch([column], ["text"]))) == column.to_pylist()
    assert sorted(language.classify(docs, *model).select("doc_id", "lang_pred", "score").collect()) == whole


def test_language_odd(odd, empty):
    langs, matrix = language.learn(odd)
    got = {(r["doc_id"], r["text"]): r for r in language.classify(odd, langs, matrix).collect()}
    assert all(got[i, TEXTS[i]]["lang_pred"] == "und" and got[i, TEXTS[i]]["score"] == 0 for i in (0, 1, 2))
    assert language.learn(empty)[0] == [] and language.classify(odd, *language.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert "node" in language.classify(odd, langs, matrix).columns


# 9: leaks
def test_leaks_of_edited_passages(spark, odd, empty):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(4000)]
    items = [" ".join(rng.choice(words, n)) for n in (40, 25, 3, 12)] + [None, ""]
    texts = []
    for k in range(40):
        passage = items[k % 4].split()
        if k % 3 == 1 and len(passage) > 20:
            passage = passage[1:]
        if k % 3 == 2:
            passage = passage[:len(passage) // 2]
        texts.append(" ".join([*rng.choice(words, 50), *passage, *rng.choice(words, rng.integers(0, 50))]).upper())
    texts += ["", None, items[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = set()
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, item in enumerate(items[:4]):
            m, k = len(item.split()), min(5, len(item.split()))
            grams = lambda ws: Counter(tuple(ws[j:j + k]) for j in range(len(ws) - k + 1))  # noqa: B023, E731
            for s in range(max(1, len(w) - m + 1)):
                a, b = grams(w[s:s + m]), grams(item.split())
                if a and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                    expected.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, bench).collect()} == expected and len(expected) > 10
    assert leaks.find_leaks(odd, empty.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() == 0
    assert leaks.find_leaks(empty, bench).count() == 0 and leaks.find_leaks(odd, bench).count() == 0


# 10: packing
def check_pieces(rows, docs):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for text, pieces in ((t, by_doc[d]) for d, t in docs):
        ids, at = ids_of(text), 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces[:-1])]).tolist()
        size = sum(p["length"] for p in pieces)
        assert size <= packing.WINDOW and size & size - 1 == 0  # nothing is padded


@pytest.mark.parametrize("most_open", [3, packing.MOST_OPEN])
def test_packing(spark, folder, most_open):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b " * 9000)], "doc_id long, text string"))
    check_pieces(packing.pack(docs, most_open=most_open).collect(), [tuple(r) for r in docs.collect()])


def test_sum_of_squares_chooses_the_least():
    packer = packing.SumOfSquares(10, 0)
    packer.counts[[3, 6]] = 2, 1
    costs = {h: sum(v * v for v in _moved(packer.counts.copy(), h, 4)) for h in (0, 3, 6)}
    assert costs[packer.level_for(4)] == min(costs.values())


def _moved(counts, level, size):
    counts[level] -= level > 0
    if level + size < 10:
        counts[level + size] += 1
    return counts[:10].tolist()


def test_packing_odd(odd, empty):
    assert packing.pack(odd).groupBy("doc_id").count().count() == odd.select("doc_id").distinct().count() and packing.pack(empty).count() == 0
