"""Each operator against brute force, a round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import base64
import gzip
import math
import random
import re
import time
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import ann, bpe, common, decontaminate, line_dedup, lm, near_dups, pii, quality, secrets, shingles, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", words string, n long, score double, chunk string, rep long"


def table(spark, texts, schema=DOCS, first=0):
    rows = [(first + k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame([(*r, "w", 1, 0.5, "c", 2) for r in rows] if schema == EXTRA else rows, schema)


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


# --- line dedup


def brute_lines(docs):
    """docs: {doc_id: text}; the texts after removal of repeated chunks."""
    from hashlib import md5

    places = {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        h = [int(md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        bits = [((a + 3 * b) >> line_dedup.END) % 2 for a, b in zip(h, h[1:], strict=False)]
        for a in range(len(bits)):
            for end in (0, 1):
                b = next((k + 2 for k in range(a, len(bits)) if bits[k] == end), None)
                chunk = "\n".join(lines[a:b])
                if b and len(chunk.encode()) >= line_dedup.MIN_BYTES:
                    places.setdefault(chunk, set()).add((i, a, b))
    gone = {(i, k) for own in places.values() for i, a, b in own if (i, a) > min(own)[:2] for k in range(a, b)}
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs.items()}


def test_lines_match_brute_force(spark):
    rng = random.Random(1)
    passage = [prose(rng, 12) for _ in range(8)]
    texts = []
    for _ in range(40):
        own = [prose(rng, rng.randint(1, 14)) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(own))
            own[at:at] = passage
        texts.append("\n".join(own))
    texts += texts[:4] + ["", "\n", "a\n\n\nb", "é\n" * 50, "one short\n" * 40]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark, table(spark, texts)).collect()}
    assert got == brute_lines(dict(enumerate(texts)))
    assert sum(map(len, got.values())) < sum(map(len, texts))


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_passages_in_other_contexts_go(spark, size):
    rng = random.Random(size)
    texts, passages = [], []
    for _ in range(25):
        passages.append([prose(rng, rng.randint(10, 30)) for _ in range(size)])
        for _ in range(3):
            own = [prose(rng, rng.randint(5, 20)) for _ in range(rng.randint(0, 6))]
            at = rng.randint(0, len(own))
            texts.append("\n".join([*own[:at], *passages[-1], *own[at:]]))
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(spark, table(spark, texts)).collect()}
    for k, own in got.items():
        kept = [x for x in texts[k].split("\n") if k % 3 == 0 or x not in passages[k // 3]]
        assert own == (kept or [""])


def test_lines_on_odd_tables(spark):
    out = line_dedup.dedup(spark, table(spark, [None, "", "x", "a\nb"], EXTRA))
    assert out.columns == [f.split()[0] for f in EXTRA.split(", ")]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(0, None), (1, ""), (2, "x"), (3, "a\nb")]
    assert line_dedup.dedup(spark, table(spark, [])).count() == 0
    long = "\n".join(f"line number {k} of a very long text" for k in range(20_000))
    got = {r.doc_id: len(r.text) for r in line_dedup.dedup(spark, table(spark, [long, long])).collect()}
    assert got == {0: len(long), 1: 0}


def test_rows_of_line_dedup_are_told_apart(spark):
    text = "a line of some length, the first\nand a second one to go with it"
    rows = [(3, text), (5, text), (5, "alone"), (None, text), (None, f"own\n{text}"), (3, text)]
    names = ["doc_id", "text", "_gone", "_VERSION", "_id", "_bucket", "_bitmap", "__gone"]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, k) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names[2:]))
    out = line_dedup.dedup(spark, docs)
    assert out.columns == names
    assert [(r.doc_id, r.text) for r in sorted(out.collect(), key=lambda r: r[7])] == [(3, text), (5, ""), (5, "alone"), (None, ""), (None, "own"), (3, text)]
    left = line_dedup.dedup(spark, docs, drop_emptied=True).collect()
    assert sorted(r[7] for r in left) == [0, 2, 4, 5] and [r[2:7] for r in left] == [(1, 2, 3, 4, 5)] * 4


# --- near duplicates


def brute_components(texts, percent=85):
    def own(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [own(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.randint(30, 200)).split() for _ in range(12)]
    texts = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "One two", "one TWO", "one two three four five", "ONE two three four five"] + texts[:5]
    comp, n = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.find(spark, table(spark, texts)).collect()}
    assert got == {k: (n[k], comp[k], comp[k] == k) for k in range(len(texts))}


def test_near_duplicates_on_odd_tables(spark):
    assert near_dups.find(spark, table(spark, [])).count() == 0
    texts = ["a b c d e f g h"] * 3 + [None]
    out = near_dups.keep(spark, table(spark, texts, EXTRA))
    assert sorted(r.doc_id for r in out.collect()) == [0, 3] and len(out.columns) == 10


def test_rows_of_near_duplicates_are_told_apart(spark):
    rng = random.Random(12)
    w, v, u = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(3, w), (5, w), (5, v), (None, v), (None, u), (5, u + " one"), (7, u + " one more"), (3, w)]
    names = ["doc_id", "text", "_id", "_version", "rep", "DOC"]
    docs = spark.createDataFrame([(*r, 1, 2, 3, k) for k, r in enumerate(rows)], "doc_id long, text string, _id long, _version long, rep long, DOC long")
    out = near_dups.keep(spark, docs)
    assert out.columns == names and sorted(r.DOC for r in out.collect()) == [0, 2, 5, 7]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dups.find(spark, docs).collect()), key=str)
    assert found == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (None, 5, False), (None, 5, False), (5, 5, True), (7, 5, False)], key=str)
    alone = near_dups.find(spark, docs.where("DOC = 4")).first()
    assert (alone.doc_id, alone.component_id, alone.kept) == (None, None, True)


def test_near_duplicates_of_the_pipeline(spark):
    # Pairs of Jaccard 0.80 to 0.85 by single substitutions, each of which changes five shingles.
    rng, texts = random.Random(8), []
    while len(texts) < 120:
        a = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(100, 250))]
        b = list(a)
        for k in rng.sample(range(len(a)), rng.randint(1, 6)):
            b[k] = "zz"
        x, y = (shingles.of(" ".join(t)) for t in (a, b))
        if 0.8 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < 0.85:
            texts += [" ".join(a), " ".join(b)]
    docs = table(spark, texts)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == list(range(0, len(texts), 2))
    assert near_dups.keep(spark, docs).count() == len(texts)  # at 85 percent none is linked


@pytest.mark.parametrize("run", ["keep", "find"])  # the pipeline's stage, op9's rows
def test_near_duplicates_collect_no_table_in_the_driver(spark, monkeypatch, run):
    plans, settle = [], common.settle
    look = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(common, "settle", lambda spark, df, name: (look(df), settle(spark, df, name))[1])
    rng = random.Random(31)
    docs = table(spark, [f"{w} {x}" for w in (prose(rng, 60) for _ in range(5)) for x in ("", "one", "one more")])
    monkeypatch.setattr(near_dups, "FEW", -1, raising=False)  # no table counts as small
    look(out := corpus_pipeline.dedup_documents(spark, docs, "") if run == "keep" else near_dups.find(spark, docs).where("kept"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 15, 3))
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("run", ["keep", "find"])  # the pipeline's stage, op9's rows
def test_near_duplicates_leave_no_shuffle_files(spark, run):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda files: {files.apply(k).getName() for k in range(files.size())}
    shuffles = lambda: {x.split("_")[1] for x in names(blocks.getAllFiles()) if x.startswith("shuffle_")}
    rng, before = random.Random(32), shuffles()
    docs = table(spark, [f"{w} {x}" for w in (prose(rng, 60) for _ in range(5)) for x in ("", "one", "one more")])
    out = corpus_pipeline.dedup_documents(spark, docs, "") if run == "keep" else near_dups.find(spark, docs).where("kept")
    end = time.time() + 5  # files go in the background
    while shuffles() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(getattr(common, "CLEANUP", "none"), None) is None  # set for the operator's own queries only
    for _ in range(2):
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, 15, 3))


def test_layouts():
    assert near_dups.layout(85) == near_dups.Layout(shingles.CHUNKS, shingles.CHUNK) and near_dups.layout(85).radius == shingles.RADIUS
    assert near_dups.layout(80).missed(80) <= near_dups.MISS < near_dups.Layout(shingles.CHUNKS, shingles.CHUNK).missed(80)


def test_pigeonhole_and_signature():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    a = " ".join(words)
    b = list(words)
    for k in rng.sample(range(3000), 40):
        b[k] = "zz"
    x, y = shingles.of(a), shingles.of(" ".join(b))
    same = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    far = (shingles.signature(x, 1024) != shingles.signature(y, 1024)).mean()
    assert abs((1 - same) - far) < 0.06
    for _ in range(200):
        bad = np.zeros(shingles.SYMBOLS, dtype=bool)
        bad[rng.sample(range(shingles.SYMBOLS), shingles.RADIUS)] = True
        assert (bad.reshape(shingles.CHUNKS, -1).sum(axis=1) <= 1).any()


# --- decontamination


def test_contamination(spark):
    rng = random.Random(4)
    items = [prose(rng, n).split() for n in (15, 20, 40, 60)] + [["Short", "item", "of", "five", "words"]]
    texts, want = [], []
    for k, w in enumerate(items):
        for wrong in (0, 1, 2):
            own = list(w)
            if len(w) > 5:
                for j in rng.sample(range(len(w)), wrong):
                    own[j] = f"q{rng.random()}"
            elif wrong:
                continue
            texts.append(f"{prose(rng, 50)} {' '.join(own).upper()} {prose(rng, 30)}")
            want.append(k)
    clean = [prose(rng, 200) for _ in range(30)] + [None, "", "   "]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    docs = table(spark, texts + clean)
    found = {r.doc_id: r["items"] for r in decontaminate.report(docs, bench).collect() if r.contaminated}
    assert found == {k: str(w) for k, w in enumerate(want)}
    assert sorted(r.doc_id for r in decontaminate.clean(table(spark, texts + clean, EXTRA), bench).collect()) == list(range(len(texts), len(texts) + len(clean)))
    assert decontaminate.report(table(spark, []), bench).count() == 0
    assert decontaminate.clean(docs, bench.where("item_id < 0")).count() == len(texts) + len(clean)


def test_seeds_meet_every_allowed_placing():
    from itertools import combinations

    for n in range(1, decontaminate.LONG):
        own = decontaminate.masks([n])
        clear = [sum(1 << (at + k) for k, c in enumerate(m) if c == "1") for m, lo, hi in own if lo <= n <= hi for at in range(n - len(m) + 1)]
        wrong = int(n * (1 - decontaminate.SHARE) + 1e-9)
        assert all(any(not c & bad for c in clear) for bad in (sum(1 << k for k in places) for places in combinations(range(n), wrong))), n
    rng = random.Random(13)
    for n in range(decontaminate.LONG, 80):
        clear = [sum(1 << (at + k) for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for at in range(n - decontaminate.SPAN + 1)]
        bad = [sum(1 << k for k in rng.sample(range(n), n // 5)) for _ in range(300)]
        assert sum(any(not c & b for c in clear) for b in bad) >= 299, n


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST, 0])
def test_short_items_and_both_paths(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most)
    rng = random.Random(14)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 3, 4, 5, 7, 8, 9, 10, 14, 19, 24, 30, 60)}
    texts, want = [], []
    for n, w in items.items():
        for wrong in range(n // 5 + 2):
            own = list(w)
            for j in rng.sample(range(n), min(n, wrong)):
                own[j] = "other"
            texts.append(" ".join([*prose(rng, rng.randint(0, 9)).split(), *own, *prose(rng, 5).split()]))
            right = [x == y for x, y in zip(own, w, strict=True)]
            best = now = 0
            for x in right:
                now = max(0, now + (1 if x else -2))
                best = max(best, now)
            want.append(sum(right) >= 0.8 * n or best >= decontaminate.RUN)
    bench = spark.createDataFrame([(n, " ".join(w).upper()) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.report(table(spark, [*texts, "word " * 50_000]), bench).collect()}
    assert got == dict(enumerate([*want, False]))
    item = " ".join(items[30])
    rows = [(None, item), (7, item), (7, "a clean text"), (None, "clean too"), (None, None), (7, item)]
    docs = spark.createDataFrame([(*r, 1, 2, k) for k, r in enumerate(rows)], "doc_id long, text string, _id long, __found long, _VERSION long")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and sorted(r[4] for r in out.collect()) == [2, 3, 4]
    assert sorted(r.contaminated for r in decontaminate.report(docs, bench).collect()) == [False] * 3 + [True] * 3


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(None, P.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: k for k, b in enumerate(tokens)}, special_tokens={})
    return bpe.Encoder(tokens, bpe.splits(tokens), P.PATTERN), theirs


def test_merges_are_exact(encoders):
    ours, theirs = encoders
    rng = random.Random(5)
    parts = ["the", "ing", "tion", " ", "  ", "\n", "\t", "é", "ß", "漢", "🙂", "1", "23", "'s", ",", "!", "a", "b", "\xa0", "​", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = theirs.encode_ordinary(text)
        assert ours.encode(text) == ids and ours.decode(ids) == text.encode()
        assert ours.digests(text) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
    for text in ("a" * 30_000, "theing" * 5000, "é" * 9000, " " * 4000, "\n" * 4000):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_a_piece_takes_one_pass(encoders, monkeypatch):
    ours, theirs = encoders
    real, calls = ours.automaton, []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(real, name)

    monkeypatch.setattr(ours, "automaton", Counted())
    for text in (" oueauquetre", " Inereaernt", "theing" * 50, "漢é🙂" * 9):
        del calls[:]
        assert [k for p in ours.pattern.findall(text) for k in ours.encode_piece(p.encode())] == theirs.encode_ordinary(text)
        assert len(calls) <= len(ours.pattern.findall(text))


def test_digests_of_a_table(spark, encoders):
    import public_tokenizers as P

    texts = [None, "", "the thing", "the thing", "x" * 5000]
    rows = bpe.digests(spark, table(spark, texts, EXTRA), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for r in rows:
        ids = encoders[1].encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
    whole = bpe.encode(spark, table(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [r.decoded for r in sorted(whole)] == [t or "" for t in texts]
    assert bpe.digests(spark, table(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- secrets


def test_secrets_in_plain_text():
    plain = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(6)
    parts = ["password", "TOKEN", "api_key", "apikey", "=", ":", '"', "'", " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN12", "f00", "é", "\n", "x", ".", "secreT", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), m.end(), 0) for m in plain.finditer(text) if len(m[2]) >= 12]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base, spans = secrets.find(text)
        assert base == sorted(want, key=lambda s: (s[0], s[2])) and set(base) <= set(spans)


def test_secrets_behind_layers():
    secret = 'token = "abcdefghijklmnop"'
    b64 = lambda b: base64.b64encode(b).decode()
    percent = "".join(f"%{x:02X}" for x in secret.encode())
    layers = [percent, percent.replace("%", "%25"), "".join(f"\\u{ord(c):04x}" for c in secret), "".join(f"&#{ord(c)};" for c in secret), b64(secret.encode()), b64(b64(secret.encode()).encode()), b64(gzip.compress(secret.encode() * 2)), b64(zlib.compress(secret.encode() * 2)), b64(percent.encode())]
    for x in layers:
        base, spans = secrets.find(f"é before {x} after")
        assert not base and spans and all(9 <= a and b <= 9 + len(x) for a, b, _ in spans), x
    split = "pass%77ord: ABCDEFGHIJKLM"
    assert secrets.find(split)[1] == [(0, len(split), 0)]
    bomb = b64(gzip.compress(b"0" * (secrets.MAX_UNPACKED + 5)))
    assert secrets.find(bomb)[1] == []


def test_secrets_behind_harder_layers():
    import textwrap

    import zstandard

    secret = 'token = "abcdefghijklmnop"'
    raw = secret.encode()
    b64 = lambda b: base64.b64encode(b).decode()
    nine = raw * 2
    for k in range(9):
        nine = (gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress)[k % 3](nine)
    noise = bytes(random.Random(15).randrange(256) for _ in range(3000))
    layers = {
        "nine": b64(nine), "path": f"data/{b64(raw)}", "path before": f"{b64(raw)}/more-of-it", "shifted": f"ab{b64(raw)}", "utf-16": b64(secret.encode("utf-16")), "utf-16-be": b64(secret.encode("utf-16-be")),
        "latin": b64(("é" + secret).encode("latin-1")), "percent": "%FF" + "".join(f"%{x:02X}" for x in raw), "member": b64(gzip.compress(b"first") + gzip.compress(raw)), "binary": b64(noise[:40] + raw + noise[40:80]),
        "wrapped": "\n".join(textwrap.wrap(b64(gzip.compress(noise + b" " + raw)), 76)), "wrapped text": "\r\n".join(textwrap.wrap(b64(raw * 5), 20)), "names": secret.replace('"', "&quot;").replace("=", "&equals;"),
        "two frames": b64(zstandard.ZstdCompressor().compress(b"one") + zstandard.ZstdCompressor().compress(raw)),
    }
    for name, x in layers.items():
        base, spans = secrets.find(f"é before {x} after")
        assert any(k == 0 and 9 <= a and b <= 9 + len(x) for a, b, k in spans) and not base, name
    loop = secrets._opened(gzip.compress(b"x" * 50))
    assert loop[-1] == b"x" * 50
    assert secrets.find("A" * 200_000)[1] == [] and secrets.find("%FF%FE" * 50_000)[1] == []


def test_secrets_of_a_table(spark):
    texts = [None, "", "token: abcdefabcdefabcd", "token: abcdefabcdefabcd", "x " * 100_000]
    rows = {r.doc_id: r for r in secrets.report(spark, table(spark, texts, EXTRA)).collect()}
    assert rows[0].base_sha256 == rows[1].base_sha256 == sha256(b"").hexdigest()
    assert rows[2].spans == rows[3].spans == "assign:0:23,hex:7:23" and (rows[2].n_assign, rows[2].n_hex) == (1, 1)
    assert secrets.report(spark, table(spark, [])).count() == 0


# --- neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 24))
    x[600:900] = x[0] + 0.1 * rng.normal(size=(300, 24))
    x[1000:1010] = x[50]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] + [1.0] * 23), (2150, [None] + [1.0] * 23), (2200, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (3, rows[3][1])]
    got = ann.search(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1200, 50))
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hit = 0
    for q, own in found.items():
        own.sort()
        s = u @ u[q]
        s[q] = -9
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[v] - c) < 1e-12 for _, v, c in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        hit += len({v for _, v, _ in own} & set(np.lexsort((np.arange(1200), -s))[:5]))
    assert hit / (5 * len(found)) >= 0.9
    assert [v for _, v, _ in sorted(found[50])] == [1000, 1001, 1002, 1003, 1004]


def searched(x, settings, k=5):
    """Recall of the k nearest, and the share of vectors compared, for every 50th row."""
    asked = np.arange(0, len(x), 50)
    met = np.zeros((len(asked), len(x)), dtype=bool)
    for t in range(settings.tables):
        filed, looked = ann.bucket(x, t, settings.second), ann.probes(x[asked], t, settings.second, settings.probes)
        for i, own in enumerate(looked):
            met[i] |= np.isin(filed, own)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -9
    near = np.argsort(-s, axis=1)[:, :k]
    return np.take_along_axis(met, near, 1).mean(), met.mean(), near


def test_settings_suit_the_size():
    rng, shares = np.random.default_rng(8), []
    middles = rng.normal(size=(400, 64))
    for n in (2000, 10_000, 50_000):
        x = middles[rng.integers(0, 400, n)] + 0.7 * rng.normal(size=(n, 64))
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        near = searched(x, ann.Settings(1, 1, 0))[2][: ann.FIT]
        q = np.repeat(np.arange(0, 50 * len(near), 50), 5)
        own = ann.fit(x[q], x[near.ravel()], np.arange(len(q)), n, n // 50)
        recall, share, _ = searched(x, own)
        print(n, own, recall, share)
        assert recall >= 0.9
        shares.append(share)
    assert shares[2] < 0.6 * shares[0]


def test_neighbours_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.search(spark, spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [-1.0, 0.1])], schema)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(spark, spark.createDataFrame([], schema)).count() == 0
    h = ann.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


# --- toxicity and quality


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        w = prose(rng, rng.randint(5, 300)).split()
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["grimblefoul", "vexatious", "odiousness"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(not bad), int(bad)))
    return rows, labels


def test_toxicity_learns_from_the_rest_only(spark):
    rows, labels = labelled(random.Random(8), 600)
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1}
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "odiousness " * 20_000), rows[0]], "doc_id long, text string").withColumn("score", F.lit(1))
    of = lambda flip: spark.createDataFrame([(k, q, 1 - t if flip and k in held else t) for k, q, t in labels], "doc_id long, quality int, toxic int")
    one, two = ({r.doc_id: (r.held_out, r.score, r.predicted) for r in toxicity.scored(spark, docs, of(flip)).collect()} for flip in (False, True))
    assert one == two and {k for k, v in one.items() if v[0] and k < 600} == held
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for _, s, p in one.values())
    right = sum(one[k][2] == t for k, _, t in labels if k in held) / len(held)
    assert right > 0.95 and one[9000][1] == one[9001][1] < 0.7 and one[9002][2] == 1
    kept = {r.doc_id for r in toxicity.clean(spark, docs, of(False)).collect()}
    assert kept == {k for k, v in one.items() if not v[2]}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(spark, table(spark, ["a", None], EXTRA), none).collect()
    assert [r.score for r in got] == [0.5, 0.5] and toxicity.scored(spark, table(spark, []), none).count() == 0


def test_quality_by_two_views(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        good = rng.random() < 0.7
        w = prose(rng, rng.randint(20, 200))
        text = w if good else rng.choice([w.upper().replace(" ", "!! "), w.replace(" ", " | "), "again " * 60, w.replace(" ", "### ")])
        rows.append((k, text, "en", f"src{rng.randrange(4) if good else 3 + rng.randrange(3)}", len(text)))
        if k % 3 == 0:
            labels.append((k, int(good), 0))
    truth = {k: int("|" not in t and "!!" not in t and "###" not in t and not t.startswith("again again")) for k, t, *_ in rows}
    docs = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", "en", "src1", 0)], DOCS)
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(spark, docs, own).collect()}
    assert len(got) == 902 and all(0 <= x <= 1 for r in got.values() for x in (r.score, r.text_score, r.meta_score))
    assert sum(got[k].keep == truth[k] for k in truth) / len(truth) > 0.95
    none = quality.score(spark, table(spark, ["a", None], EXTRA), own.where("doc_id < 0")).collect()
    assert [r.score for r in none] == [0.5, 0.5] and quality.score(spark, table(spark, []), own).count() == 0


def test_quality_reads_the_content(spark):
    # Good and bad texts differ by their words alone; few have labels, and held-out ones count.
    rng, rows, labels = random.Random(16), [], []
    for k in range(1200):
        good = rng.random() < 0.6
        first = 0 if good else 150
        text = " ".join(f"w{first + rng.randrange(200)}" for _ in range(rng.randint(40, 90)))
        rows.append((k, text, "en", f"src{rng.randrange(4) if good else 2 + rng.randrange(4)}", len(text)))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, DOCS)
    own = spark.createDataFrame([x for x in labels if x[0] % 4 == 0 or zlib.crc32(str(x[0]).encode()) % 3 == 1] + [(0, 1 - labels[0][1], 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(spark, docs, own).collect()}
    held = [k for k in got if got[k].held_out]
    right = lambda name: sum((getattr(got[k], name) >= 0.5) == labels[k][1] for k in held) / len(held)
    assert right("text_score") > 0.95 and right("score") > 0.95 and right("meta_score") > 0.6


# --- surrogates


def test_permutations_are_permutations():
    key = b"k" * 32
    for n in (1, 2, 7, 10, 26, 100, 997):
        assert sorted(pii.permuted(x, n, key, "t") for x in range(n)) == list(range(n))
    odd = [pii.permuted(x, 500, key, "t", lambda v: v % 3) for x in range(500)]
    assert sorted(odd) == list(range(500)) and all(a % 3 == b % 3 for a, b in enumerate(odd))


def test_surrogates():
    key = b"k" * 32
    text = "Mail jo.doe7@mail3.example.com or jo.doe7@mail3.example.com, call +1 (826) 555-4081 or 826-555-4081, ip 10.1.2.3 and 8.8.4.4, card 4111 1111 1111 1111, Mrs. Anna Keller, Herr Peter Keller, Анна Петрова, Paul Keller."
    new, found = pii.replace(text, key)
    kinds = Counter(k for _, _, k in found)
    assert kinds == {"email": 2, "phone": 2, "ip": 2, "card": 1, "name": 4}
    for a, b, _ in found:
        assert text[a:b] not in new
    mails = re.findall(r"\S+@[\w.]+[a-z]", new)
    assert mails[0] == mails[1] and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d@[a-z]{4}\d\.example\.com", mails[0])
    phones = re.findall(r"\+1 (\(\d{3}\)) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})", new)
    assert phones and phones[0][0] == f"({phones[0][2]})" and phones[0][1] == phones[0][3]
    assert pii._luhn(re.search(r"card ([\d ]+),", new)[1].replace(" ", ""))
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", new)
    import ipaddress

    assert ipaddress.ip_address(ips[0]).is_private and not ipaddress.ip_address(ips[1]).is_private
    anna = re.search(r"Mrs\. (\w+) (\w+), Herr (\w+) (\w+), (\w+) \w+, (\w+) (\w+)\.", new)
    assert anna[1] in pii.NAMES["female-latin"] and anna[3] in pii.NAMES["male-latin"] and anna[5] in pii.NAMES["female-cyrillic"]
    assert anna[2] == anna[4] == anna[7] and pii.replace(text, b"z" * 32)[0] != new


def test_no_entity_stays():
    names = ["Dr Νίκος Παπαδόπουλος", "Dr 王小明", "Frau Łł", "Dr Йй", "Herr ßß", "Dr محمد علي", "Mr Ñç", *(f"{n} Keller" for g in pii.NAMES.values() for n in g)]
    texts = [*names, "用户@example.com", "ñ@example.com", "ж@example.com", "a@example.com", "10.0.0.1", "255.255.255.255", "4111 1111 1111 1111", "+1 (826) 555-4081"]
    for key in (bytes([k]) * 32 for k in range(8)):
        for text in texts:
            new, found = pii.replace(text, key)
            assert len(found) == 1, text
            a, b, kind = found[0]
            parts = zip(text[a:b].split(" "), new[a:].split(" "), strict=True) if kind == "name" else [(text[a:b], new[a:])]
            assert all(x != y for x, y in parts), (text, new)
    for n in (2, 7, 10, 26, 100, 997):
        assert all(pii.permuted(x, n, b"k" * 32, "t") != x for x in range(n))


def test_the_same_entity_keeps_its_surrogate():
    key = b"k" * 32
    new, found = pii.replace("hosts 1.2.3.4 and 01.2.3.4, Jo@x.org and jo@X.ORG", key)
    ips, mails = re.findall(r"\d+\.\d+\.\d+\.\d+", new), re.findall(r"\S+@\S+", new)
    assert len(found) == 4 and ips[0] == ips[1] != "1.2.3.4" and mails[0] != mails[1] and mails[0].lower() == mails[1].lower() and mails[0][0].isupper()
    new, found = pii.replace("Mrs. Anna Keller. Keller said; Anna left. ANNA KELLER; McAnna stays, kellers stay. Mr McDonald, MCDONALD", key)
    m = re.fullmatch(r"Mrs\. (\w+) (\w+)\. (\w+) said; (\w+) left\. (\w+) (\w+); McAnna stays, kellers stay\. Mr (\w+), (\w+)", new)
    assert m[1] == m[4] and m[2] == m[3] and m[5] == m[1].upper() and m[6] == m[2].upper() and m[7].upper() == m[8] and len(found) == 7
    assert not {"Anna", "Keller", "McDonald"} & set(re.findall(r"\w+", new.replace("McAnna", "")))


def test_more_kinds_of_entities():
    key = b"k" * 32
    cases = {
        "06 12 34 56 78": "phone", "555 123 4567": "phone", "123-45-6789": "national", "DE89 3704 0044 0532 0130 00": "iban", "GB29NWBK60161331926819": "iban",
        "2001:db8:0:1:2:3:4:5": "ip6", "fe80::1ff:fe23:4567": "ip6", "221 Baker Street": "address", "12 rue de la Paix": "address", "Calle Mayor, 7": "address", "Bahnhofstraße 12": "address",
    }
    for text, kind in cases.items():
        new, found = pii.replace(f"at {text}, then", key)
        assert [(text, k) for _, _, k in found] == [(text, kind)] and text not in new, text
        other = new[3 : -len(", then")]
        assert pii.entities(f"at {other}, then")[0][2] == kind and re.sub(r"\w", "", other).replace(":", "") == re.sub(r"\w", "", text).replace(":", "")
    assert pii.replace("GB29NWBK60161331926818 at 12:34:56 in std::vector or a::b", key)[1] == []
    assert pii._iban_rest(pii.replace("GB29NWBK60161331926819", key)[0]) == 1
    names = pii.replace("My name is Zebulon Quince. Ich heiße Wiebke Ohm. Меня зовут Глеб Ушаков.", key)
    assert [k for _, _, k in names[1]] == ["name"] * 3
    numbers = [f"{k:03d}-{k % 89 + 10}-{k + 1000}" for k in range(1, 600)]
    assert len({pii.replace(x, key)[0] for x in numbers}) == len(numbers)
    long = "Dr Ohm met Dr Ahm at 10.0.0.1. " * 20_000
    new, found = pii.replace(long, key)
    assert len(found) == 60_000 and new == pii.replace(long[: len(long) // 20_000], key)[0] * 20_000


def test_surrogates_stay_distinct(spark):
    texts = [f"write to user{k}@host{k % 7}.org from {k % 250}.{k % 199}.7.{k % 11 + 1}" for k in range(800)] + [None, "", "nothing here"]
    got = {r.doc_id: r for r in pii.report(spark, table(spark, texts, EXTRA), "key").collect()}
    for part in (3, 4):
        pairs = {(texts[k].split()[part - 1 if part == 3 else part], got[k].text.split()[part - 1 if part == 3 else part]) for k in range(800)}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert got[800].text is None and got[801].text == "" and got[802].text == "nothing here"
    assert pii.report(spark, table(spark, []), "key").count() == 0


# --- language model


def test_scores(spark, monkeypatch):
    rng = random.Random(10)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}
    texts = []
    for _ in range(400):
        w, out = rng.randrange(60), []
        for _ in range(rng.randint(0, 40)):
            out.append(f"T{w}" if rng.random() < 0.97 else f"rare{rng.randrange(500)}")
            w = rng.choice(follow[w])
        texts.append(" ".join(out))
    texts += [None, "", "never seen words"]
    monkeypatch.setattr(lm, "KEEP", 100)
    rows = {r.doc_id: r for r in lm.score(spark, table(spark, texts, EXTRA)).collect()}
    counts = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update([*common.tokens(t), b""])
    total, types = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        own, r = [*common.tokens(t), b""], rows[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "KEEP", 60)
    monkeypatch.setattr(lm, "MODEL_WORDS", 25)
    rng = random.Random(17)
    texts = [" ".join(f"w{int(120 * rng.random() ** 2)}" for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "w1 neverseen w1", "W1  w2" * 3000]
    docs = table(spark, texts).select("doc_id", "text", F.lit(False).alias("held_out"))
    counts, v = lm.counted(spark, docs.where("doc_id < 200"))
    own = lm.encoded(spark, docs, v)
    model = lm.train(spark, own.where("doc_id < 200"), v)
    got = {r.doc_id: r.score for r in lm.applied(spark, own, counts, v, model).collect()}
    n = Counter(w for t in texts[:200] for w in [*common.tokens(t), b""])
    top = v.words[: v.n_model]
    outcome = {w: k for k, w in enumerate(top)} | {b"": v.end}
    of = lambda w: outcome.get(w, v.n_model + 1 + lm.bucket(w) if w else None)
    classes = Counter()
    for w in n:
        if w and w not in outcome:
            classes[of(w)] += n[w] + 1
    q, b = model.target.astype(float), model.bias.astype(float)

    def chance(far, near):
        r = model.context[far].astype(float) @ model.places[0] + model.context[near].astype(float) @ model.places[1]
        p = np.exp(r @ q.T + b)
        return p / p.sum()

    def share(w):
        return 1.0 if w in outcome else (n[w] + 1) / (classes[of(w)] + 1)

    for k, t in enumerate(texts[:40] + texts[200:203]):
        k = k if k < 40 else 160 + k
        far = near = v.outcomes
        total = 0.0
        for w in [*common.tokens(t), b""]:
            total += math.log10(chance(far, near)[of(w)] * share(w))
            far, near = near, of(w)
        assert math.isclose(got[k], total, rel_tol=2e-4, abs_tol=1e-3), (k, got[k], total)
    # Over all next words, with one unseen word a class, probabilities add up to 1.
    p = chance(outcome[top[0]], outcome[top[1]])
    every = sum(p[of(w)] * share(w) for w in n) + sum(p[v.n_model + 1 + c] / (classes[v.n_model + 1 + c] + 1) for c in range(lm.BUCKETS))
    assert math.isclose(every, 1, rel_tol=1e-9)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(11)
    n = 30
    noise = np.full(n, 1 / n)
    model, state = lm.Model.start(noise), None
    state = np.full_like(model.flat, 1e-6)
    near = rng.integers(0, n, 40_000)
    word = (near * 7 + 1) % n
    far = rng.integers(0, n, 40_000)
    for _ in range(3):
        for k in range(0, len(word), 1024):
            model.train(far[k : k + 1024], near[k : k + 1024], word[k : k + 1024], noise, state, rng)
    one, two, norm = model.tables()
    p = np.exp(one[:, None, :] + two[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-3)
    assert p[far[:500], near[:500], word[:500]].mean() > 0.3


def test_every_position_teaches(spark):
    # Texts of two words and ids of one residue: the second word and the end lie at places that a stride would leave out.
    n = 100_000
    texts = spark.range(0, n, 1, 2).select((8 * F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 1, "a b").otherwise("c d").alias("text"))
    counts = spark.createDataFrame([(bytearray(w), n // 2) for w in (b"a", b"b", b"c", b"d")] + [(bytearray(), n)], "word binary, n long")
    v = lm.vocabulary(counts)
    one, two, norm = lm.train(spark, texts, v).tables()
    at = {w: k for k, w in enumerate(v.words)}
    p = lambda far, near, word: float(np.exp(one[far, word] + two[near, word] - norm[far, near]))
    before = v.outcomes
    assert p(before, at[b"a"], at[b"b"]) > 3 * p(before, at[b"a"], at[b"d"]) and p(before, at[b"c"], at[b"d"]) > 3 * p(before, at[b"c"], at[b"b"])
    assert p(at[b"a"], at[b"b"], v.end) > 3 * p(at[b"a"], at[b"b"], at[b"a"])


def test_lessons_cover_all_positions():
    v = lm.Vocabulary([b"x", b"y"], np.array([5.0, 4.0]), 2, np.ones(lm.BUCKETS), np.ones(lm.BUCKETS), 9, 2)
    rng = random.Random(5)
    texts = [None, "", *(" ".join(rng.choices("xyz", k=rng.choice((1, 7, 3000, 5000)))) for _ in range(30)), ""]
    got = list(lm.lessons(iter(texts), lm.Reader(v)))
    assert [len(w) for _, _, w in got[:-1]] == [lm.BATCH] * (len(got) - 1)
    words = [lm.Reader(v).read(t)[1] for t in texts]
    assert np.array_equal(np.concatenate([w for _, _, w in got]), np.concatenate(words))
    assert np.array_equal(np.concatenate([n for _, n, _ in got]), np.concatenate([[v.outcomes, *w[:-1]] for w in words]))


def test_scores_of_an_empty_table(spark):
    assert lm.score(spark, table(spark, [])).count() == 0
