"""Every operator against a plain version on a small fixture, with nulls, ties, repeats and extra columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from graphloom.llm import chat, debruijn_dedup, decontaminate, embed_dedup, html_text, packing, quality, simhash, suffix_dedup, toxicity
from graphloom.llm.suffixes import suffix_array

WORDS = "[^\x20\x09-\x0d]+"
DOC = "doc_id long, text string, h long, z string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, "z", "en", "s", 0) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        a = rng.randrange(220)
        rows.append((i, " ".join(own + base[a : a + rng.randrange(90)] + ["ab"] * rng.randrange(60))))
    rows += [(100, None), (101, ""), (102, "x " * 500), (103, "é  " * 300), (104, rows[3][1]), (105, " \t\n"), (106, "One")]
    return rows


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(3000):
        t = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(14))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_dedup(spark, texts, hot):
    seen, want = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(documents(spark, texts), hot=hot).collect()}
    assert got == want
    whole = suffix_dedup.dedup(documents(spark, texts))
    assert whole.columns == documents(spark, texts).columns and whole.count() == len(texts)


@pytest.mark.parametrize("hot", [2000, 3])
def test_debruijn_dedup(spark, texts, hot):
    met = collections.Counter()
    for _, t in texts:
        w = re.findall(WORDS, t or "")
        met.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    want = {}
    for i, t in texts:
        w = re.findall(WORDS, t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if met[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    rows = debruijn_dedup.digests(documents(spark, texts), hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    assert sum(r.n_paths for r in rows) == debruijn_dedup.paths(documents(spark, texts), hot=hot).count() > 0


def test_debruijn_dedup_of_null_and_shared_ids(spark):
    """Short texts keep their words beside long repeated ones with the same id, or without one."""
    rng = random.Random(9)
    span = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    long = [(None, f"a {span} b"), (None, f"{span} c d"), (7, f"e f {span}"), (7, f"{span} g")]
    short = [(None, "a short text"), (None, " ".join(f"s{k}" for k in range(34))), (None, None), (7, "another one"), (7, "")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in debruijn_dedup.dedup(documents(spark, long + short)).collect())
    want = [(i, 80 + t.count(" ") - 79, 80, " ".join(t.replace(span, "").split())) for i, t in long]
    want += [(i, len((t or "").split()), 0, t or "") for i, t in short]
    assert got == collections.Counter(want)


def test_debruijn_paths(spark):
    rng = random.Random(1)
    span = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [(1, f"a b {span} c"), (2, f"d {span} e f"), (3, "nothing here")]
    got = debruijn_dedup.paths(documents(spark, rows)).collect()
    assert [(r.edges, r.times) for r in got] == [(200 - 34, 2)]


def test_debruijn_paths_of_a_periodic_text(spark):
    """50 words over and over: 50 distinct edges, the first ones met once more than the last."""
    period = [f"p{k}" for k in range(50)]
    words = [period[k % 50] for k in range(434)]
    got = debruijn_dedup.paths(documents(spark, [(1, " ".join(words))])).collect()
    edges = 434 - 34
    assert sum(r.edges for r in got) == 50 and sum(r.edges * r.times for r in got) == edges
    assert debruijn_dedup.digests(documents(spark, [(1, " ".join(words))])).first().n_removed == 434


def test_debruijn_removes_what_its_paths_say(spark, monkeypatch):
    span = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a {span}"), (2, f"{span} b")]
    assert [r.n_removed for r in debruijn_dedup.digests(documents(spark, rows)).collect()] == [60, 60]
    whole = debruijn_dedup.glue
    monkeypatch.setattr(debruijn_dedup, "glue", lambda found: whole(found).where("false"))
    assert [r.n_removed for r in debruijn_dedup.digests(documents(spark, rows)).collect()] == [0, 0]


def test_one_anchor_in_very_many_segments(spark):
    """A phrase in ever new surroundings: no task holds its segments, and passages that do repeat are found."""
    rng = random.Random(4)
    phrase = "the same eight words stand here each time"
    rows = [(k, " ".join([f"u{rng.randrange(10**9)}" for _ in range(40)] + [phrase] + [f"v{rng.randrange(10**9)}" for _ in range(40)])) for k in range(6000)]
    rows += [(6000 + k, f"x{k} " + rows[k][1]) for k in range(5)]
    got = {r.doc_id: r.n_removed for r in debruijn_dedup.digests(documents(spark, rows)).collect()}
    assert {k for k, n in got.items() if n} == {*range(5), *range(6000, 6005)} and {got[k] for k in range(5)} == {88}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digests(documents(spark, rows)).collect()}
    assert {k for k, n in got.items() if n} == set(range(6000, 6005))


def _fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(WORDS, text or "")]
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(ids, linked):
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            label[a] = min([label[a], *(label[b] for b in ids if b != a and linked(a, b))])
    return label


def test_simhash(spark, texts):
    fp = {i: _fingerprint(t) for i, t in texts}
    want = _groups(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = simhash.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == want


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 16)).astype(np.float32)
    for k in range(60):
        x[100 + k] = x[k] + rng.standard_normal(16).astype(np.float32) * 0.12
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, rows[0][1]), (305, []), (306, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, size int")
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    ids = [i for i, _ in rows]
    want = _groups(ids, near)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(near(i, j) for j in ids if j != i) for i in ids}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items())
    tiled = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, tile=8).collect()}
    assert tiled == {i: r.n_links for i, r in got.items()}


@pytest.mark.parametrize("n, dim", [(1_000, 64), (50_000, 64), (2_000_000, 64), (20_000, 384)])
def test_filters_find_pairs_at_the_threshold(n, dim):
    """Recall of the filters for a table of n vectors, on pairs at cosine 0.951, and how many filters a vector costs."""
    rng = np.random.default_rng(3)
    code = embed_dedup.Code(dim, *embed_dedup.shape(n))
    x, z = (rng.standard_normal((600, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = [np.intersect1d(a, b).size > 0 for a, b in zip(code.decode(x, 16), code.decode(y, 16))]
    assert np.mean(met) >= 0.99 and np.mean([len(f) for f in code.decode(x, 16)]) < 80


def test_embeddings_against_brute_force_in_64_dimensions(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    for k in range(300):
        z = rng.standard_normal(64)
        z -= z @ x[k] / (x[k] @ x[k]) * x[k]
        c = 0.9 + 0.1 * k / 300
        x[1200 + k] = c * x[k] / np.linalg.norm(x[k]) + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95) & ~np.eye(1500, dtype=bool)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(rows).collect()}
    want = near.sum(1)
    assert want.sum() > 250 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in range(1500))


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    packed = packing.pack(documents(spark, [*texts, (107, "long text. " * 3000)]), path)
    assert dict(packed.dtypes) == {"piece": "int", **dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"), "bigint")}
    rows = packed.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in [*texts, (107, "long text. " * 3000)]:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= sum(r.length for r in rows) / 2048 * 1.05 + 1


def test_encoder_equals_the_tokenizer():
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    signs = ["a", "B", "  ", " ", "\n", "\t", "é", "'s", "1", ".", "!?", "中", "_", "<|endoftext|>", " "]
    for _ in range(2000):
        s = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert enc.encode([s])[0] == np.array(enc.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    points = [chr(c) for c in [*range(0x3400), *range(0x3400, 0x110000, 53)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        part = [f"a{c}b {c} 1{c}2 .{c}. \n{c} a{c}\nb {c}{c}.' x" for c in points[i : i + 20_000]]
        for s, got, e in zip(part, enc.encode(part), enc.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            assert got == np.array(e.ids, "<u4").tobytes(), s
    for s in ("x" + " " * 499_000 + "y", "a" * 99_000, "x" + " " * 501_000 + "y", "ab " * 400_000):
        assert enc.encode([s])[0] == np.array(enc.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


def test_decontamination_finds_every_edited_item(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60)))) for k in range(30)]
    rows, want = [(1000, None), (1001, "")], set()
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 200))]
        if i % 2:
            k, text = rng.choice(items)
            leak = text.split()
            for _ in range(rng.randrange(int(0.2 * len(leak)) + 1)):
                leak[rng.randrange(len(leak))] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontaminate.clean(documents(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}


@pytest.mark.parametrize("n", [15, 60, 400])
@pytest.mark.parametrize("kind", ["insert", "delete", "replace"])
def test_decontamination_at_the_full_edit_bound(n, kind):
    """Items with floor(0.2 n) spread edits of one kind, by themselves and inside other text: recall is 1."""
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(3000)]
    for trial in range(25):
        item = [rng.choice(vocabulary) for _ in range(n)]
        places = sorted(rng.sample(range(1, n - 1), int(0.2 * n)), reverse=True)
        leak = list(item)
        for p in places:
            leak[p : p + (kind != "insert")] = [] if kind == "delete" else [f"x{p}"]
        around = [rng.choice(vocabulary) for _ in range(50 * (trial % 2))]
        block = decontaminate.Block([(5, " ".join(item))], decontaminate.DISTANCE)
        [(k, edits, _, end)] = block.leaks(decontaminate.words(" ".join(around + leak + around).encode()))
        assert k == 5 and 0 < edits <= int(0.2 * n) and end <= len(around) + len(leak)
        leak[::4] = ["y"] * len(leak[::4])  # now well past the bound
        assert block.leaks(decontaminate.words(" ".join(around + leak + around).encode())) == []


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [f"{rng.choice('bcdfg')}{rng.randrange(90)}" for _ in range(rng.randrange(5, 120))]
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "foul", f"grimo{rng.choice('abcdefgh')}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, "")]
    marks = spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.tag(documents(spark, rows), marks).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i].tox_score >= 0.3) == (i % 6 == 0) for i in held)
    assert got[900].tox_score == got[901].tox_score < 0.3
    span = got[0].tox_spans[0]
    assert re.fullmatch("vile|foul|grimo.", dict(rows)[0][span.start : span.end])


def test_marginals_equal_all_chains_counted():
    """Forward-backward against the sum over all chains of up to eight tokens, for texts side by side."""
    rng = np.random.default_rng(8)
    lengths, jump = np.array([3, 0, 8, 1, 5]), rng.standard_normal((2, 2))
    emission = rng.standard_normal(lengths.sum())
    p, pairs = toxicity.Layout(lengths).marginals(emission, jump)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for chain in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e for e, c in zip(emission[at : at + n], chain) if c) + sum(jump[a, b] for a, b in zip(chain, chain[1:])))
            total += w
            one += w * np.array(chain)
            for a, b in zip(chain, chain[1:]):
                two[a, b] += w
        want.extend(one / total)
        want_pairs += two / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\<s>", "<<ROLE>>x", None, "", "\\\\", "<</s>>"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", None][: c % 6 + 1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    got = {r.conv_id: r for r in chat.digests(chat.conversations(chat.threads(df))).collect()}
    for c in range(8):
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        body = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 3.0), (1, 4, 3, "user", "thanks", 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    assert chat.parse(chat.conversations(df).first().formatted) == [("user", "q"), ("assistant", "good"), ("user", "thanks")]
    assert chat.paths(df).count() == 2 + 3


def test_html(spark):
    page = (
        '<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="menu"><a href=x>a</a></div><div class="content"><h2>T &amp; x</h2>'
        "<p>Hello, world this is long text, with commas, and more text here.<p>Second \n paragraph &#8212; with a <a href=x>link</a>, ok, and more words."
        '<script>p("</p>")</script></div><div id="comments"><p>I disagree, strongly, with this text, a lot, and so on and on.</p></div><footer>f</footer>'
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<nav>a</nav>", "x")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "T & x\nHello, world this is long text, with commas, and more text here.\nSecond paragraph — with a link, ok, and more words."
    assert {(r.page_id, r.text, r.n_chars) for r in got} == {(1, want, len(want)), (2, "", 0), (None, "", 0), (3, "", 0)}


@pytest.mark.parametrize("many", [1, 5, 12, 60])
@pytest.mark.parametrize("name", ["article", "main"])
def test_html_keeps_all_sections_of_an_article_of_any_length(name, many):
    long = ("some words of prose, and more of them, " * 8).strip(" ,")
    page = (
        f"<body><nav><a href=x>menu</a></nav><div class=page><{name}><h1>Title</h1><p>Short lead.</p><div><div><section><h2>One</h2>{f'<p>{long}</p>' * many}</section></div>"
        f"<div><section><h2>Two</h2><p>Brief.</p><ul><li>first<li>second</ul></section></div></div><section><p>The end.</p></section></{name}>"
        "<div><p>Outside.</p></div></div><footer>f</footer></body>"
    )
    want = ["Title", "Short lead.", "One", *[long] * many, "Two", "Brief.", "first", "second", "The end."]
    assert html_text.extract(page).split("\n") == want


PROSE = "Some text of prose, and more of it, here and there."


@pytest.mark.parametrize("name", ["content has-sidebar", "post no-comments", "main with-sidebar", "article-header", "widget", "comments-open category-social"])
def test_html_keeps_a_text_whose_container_has_an_odd_name(name):
    assert html_text.extract(f'<body><nav>m</nav><div class="{name}"><h1>T</h1><p>{PROSE}</p></div><footer>f</footer></body>') == f"T\n{PROSE}"


def test_html_inline_controls_and_named_parts():
    page = (
        '<body><article><div class="post-header"><h1>Title</h1><span>by me</span></div><p>The <label>word</label> stays, with <button>its</button> text.</p>'
        f'<p>{PROSE}</p><div class="share-buttons">x</div><div id="relatedPosts">y</div><form><label>Name</label><input><button>Go</button></form></article>'
        f'<div class="comments"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div class="cookie-notice">We use.</div></body>'
    )
    assert html_text.extract(page) == f"Title\nThe word stays, with its text.\n{PROSE}"


@pytest.mark.parametrize(
    "page", ['<a "' * 250_000, "<div>x" * 150_000, "<div>" * 200_000, "<a b='" * 170_000, "<h1><p>" * 140_000, "<script>" + "</script" * 120_000, "<ul><li>" * 120_000]
)
def test_html_takes_time_in_proportion_to_the_page(page):
    began = time.process_time()
    html_text.extract(page)
    assert time.process_time() - began < 20  # a quadratic reader needs over an hour


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        rows.append((i, " | ".join(words) if bad else " ".join(words), f"h{i % 7}", "en"))
        labels.append((i, int(not bad), 0))
    rows += [(900, None, None, None), (901, "", "new", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i].score >= 0.5) == (i % 5 != 0) for i in held)
    assert 0.5 < got[901].score < 1 and len(got) == len(rows)


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        suffix_dedup.digests(docs), debruijn_dedup.digests(docs), simhash.near_duplicates(docs), toxicity.tag(docs, labels), quality.score(docs, labels),
        decontaminate.leaks(docs, bench), packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")),
        embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        chat.digests(chat.conversations(chat.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))),
        html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_simhash_full_cell_of_many_tiles(spark):
    """Fingerprints of few population counts, in tiles of 4: the links join the groups that all near pairs join."""
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(12):
        bits = rng.permutation(64)
        value = sum(1 << int(b) for b in bits[:32])
        for k in range(8):
            values.add(value ^ (1 << int(bits[k])) ^ (1 << int(bits[63 - 2 * k])))
            values.add(value ^ (1 << int(bits[k])))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=4).collect()

    def groups(pairs):
        up = {v: v for v in signed}

        def top(v):
            while up[v] != v:
                v = up[v]
            return v

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(v) for v in signed]

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.RADIUS]
    assert near and groups((r.x, r.y) for r in found) == groups(near)
