"""The text operators beside plain Python, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evidex.llm import bpe, licenses, mixing, passages, quality, queries, secrets, simhash, toxicity
from evidex.llm.common import tokenizer_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
PATH = f"{tokenizer_dir()}/word_bpe_49k.json"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- near copies


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc_id: smallest reachable id} of (doc_id, fingerprint) pairs."""
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in parent}


def test_near_copies(spark, sf_dir):
    docs = documents(spark, sf_dir)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_components(prints)
    got = queries.queries()["op8_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (f, want[d]) for d, f in prints}
    assert len(got) == docs.count()


@pytest.mark.parametrize("block", [2, 256])
def test_near_copies_of_many_close_fingerprints(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 6)
    prints = {}
    for i in range(240):
        fp = int(base[i % 6])
        for b in rng.integers(0, 62, rng.integers(0, 5)):
            fp ^= 1 << int(b)
        prints.setdefault(fp, 1000 - i)
    prints = [(d, f) for f, d in prints.items()]
    table = spark.createDataFrame(prints, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components_of(table, block).collect()}
    assert got == plain_components(prints)


def test_near_copies_of_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_copies(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == "0" * 16 and by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 2
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[None].component_id == 1
    assert rows(simhash.near_copies(no_docs)) == []


# --- BPE


def plain_encoding(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return ids, decoded


def test_bpe_round_trip(spark, sf_dir, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    for docs in (documents(spark, sf_dir), odd_docs):
        want = Counter()
        for r in docs.collect():
            ids, decoded = plain_encoding(r.text, tokenizer)
            want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
        assert Counter(rows(bpe.encode_documents(docs, PATH))) == want
    full = bpe.encode_documents(odd_docs, PATH, full=True).where("doc_id = 7").first()
    text = odd_docs.where("doc_id = 7").first().text
    assert (full.ids, full.decoded) == plain_encoding(text, tokenizer)
    pieces = spark.createDataFrame([(i, tokenizer.id_to_token(i)) for i in sorted(set(full.ids))], "id int, piece string")
    keyed = spark.createDataFrame([(1, full.ids), (2, [])], "key int, ids array<int>")
    assert dict(rows(bpe.decode(keyed, pieces))) == {1: full.decoded, 2: ""}
    assert rows(bpe.encode_documents(no_docs, PATH)) == []


# --- secrets

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def plain_spans(text):
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def test_secrets(spark, sf_dir, odd_docs, no_docs):
    tricky = spark.createDataFrame(
        [(1, "token: secret: abcdefghij"), (2, "API_KEY='AKIA" + "B2" * 10 + "'"), (3, "PassWd=ſecret=aaaaaaaa1 " + "ab12" * 9), (4, "é" * 9 + "apikey = " + "0" * 40)],
        "doc_id long, text string",
    )
    for docs in (documents(spark, sf_dir), odd_docs, tricky):
        want = Counter()
        for r in docs.collect():
            spans = plain_spans(r.text)
            text = ",".join(f"{BASE[k][0]}:{a}:{z}" for a, k, z in spans)
            want[(r.doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
        got = secrets.secret_spans(docs).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
    assert rows(secrets.secret_spans(no_docs)) == []


def test_learnt_formats():
    rng = np.random.default_rng(0)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    machine = secrets.Automaton([secrets.classes(w) for w in hexes], 0.05)
    assert machine.states < 60
    chain = defaultdict(Counter)
    for w in ("session-2024-overview", "chapter-12-appendix", "version-1-candidate-2"):
        for a, b in zip("^" + secrets.classes(w), secrets.classes(w) + "$"):
            chain[a][b] += 1
    model = secrets.SecretModel([machine], dict(chain), secrets.Format())
    assert model.is_secret("9f86d081884c7d659a2feaa0c55ad015")
    assert not model.is_secret("session-2025-overview")


def test_credentials_behind_long_runs(spark):
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    paths = ["/".join(f"{w}-{i}" for w in ("chapter", "session", "version", "overview", "appendix", "candidate")) for i in range(3000)]
    docs = [(i, f"token: {h}") for i, h in enumerate(hexes)] + [(1000 + i, f"see {p} now") for i, p in enumerate(paths)]
    scanned = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    model = secrets.learn(scanned)
    assert sum(model.chain["^"].values()) == 3000  # every token, not a sample
    long = "/".join(["chapter-1/session-2/overview-3/appendix"] * 6)
    secret = "9F86D081884C7D659A2FEAA0C55AD015".lower()
    assert not model.is_secret(long)
    assert model.is_secret(f"{long}/{secret}") and model.is_secret(f"{long}/{secret}/{long}")
    assert not model.is_secret(f"{long}/{long}")


def test_redaction(spark, odd_docs):
    got = {r.doc_id: r for r in secrets.redact(odd_docs).collect()}
    assert "24be6443" not in got[8].text and "[SECRET]" in got[8].text and got[2].text is None
    assert got[8].score == "" and secrets.redact(odd_docs).columns == odd_docs.columns


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {**target, **{s: level * weight[s] for s in open_}}
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark, sf_dir, odd_docs, no_docs):
    for docs in (documents(spark, sf_dir), odd_docs):
        data = docs.select("doc_id", "source", "text").collect()
        size = lambda t: len(WORD.findall(t or ""))
        sizes = defaultdict(int)
        for r in data:
            sizes[r.source] += size(r.text)
        want = plain_targets(sizes)
        got = mixing.mix(docs).collect()
        again = mixing.mix(docs.repartition(2)).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in data)
        assert all(r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size if r.size else r.taken == 0 for r in got)
        source = {r.doc_id: r.source for r in data}
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
            taken[s] += r.taken
            largest[s] = max(largest[s], r.size)
        assert all(abs(taken[s] - want[s]) <= 1.01 * largest[s] for s in want)
    assert rows(mixing.mix(no_docs)) == []


def test_capped_targets(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7)), "small" if i < 5 else "z-large") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    small = [r for r in got if r.doc_id < 5]
    assert all(r.taken == 3 * r.size and r.target == 3 * r.source_size for r in small)
    copied = mixing.mixed_documents(docs)
    assert copied.columns == docs.columns and copied.where("doc_id < 5").count() == 15


# --- passages


def exact_repeats(texts, n=50):
    """Documents that share a run of n words with another one."""
    held = defaultdict(set)
    for d, t in texts:
        words = t.lower().split()
        for i in range(len(words) - n + 1):
            held[hash(tuple(words[i : i + n]))].add(d)
    return {d for ds in held.values() if len(ds) > 1 for d in ds}


def test_passages(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    got = queries.queries()["op5_compact_window_passages"](spark, sf_dir).collect()
    named = {r.doc_id for r in got} | {r.other_id for r in got}
    assert exact_repeats(data) <= named
    texts = dict(data)
    for r in got:
        a, b = texts[r.doc_id].lower().split()[r.start_word : r.end_word], texts[r.other_id].lower().split()[r.other_start : r.other_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_planted_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(10**9))
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(30):
        own = [word() for _ in range(120)]
        at = int(rng.integers(120))
        part = list(passage)
        if i % 3 == 1:
            part[35] = word()  # a near copy: 5 of 66 runs differ
        docs.append((i, " ".join(own[:at] + (part if i < 20 else []) + own[at:]), "x"))
    table = spark.createDataFrame(docs, "doc_id long, text string, similarity string")
    got = passages.repeated_passages(table).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == set(range(20))


def test_exact_repeats_around_a_common_line(spark):
    """Pairs share 50 words, of which 44 are a line that 200 other documents hold too."""
    rng = np.random.default_rng(10)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**12, n)]
    line, docs = words(44), []
    for i in range(200):
        docs.append(words(30) + line + words(30))
    for i in range(60):
        left = i % 7
        before, after = words(left), words(6 - left)
        for _ in range(2):
            docs.append(words(30) + before + line + after + words(30))
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(5)
    got = {frozenset((r.doc_id, r.other_id)) for r in passages.repeated_passages(table).collect() if r.similarity == 1}
    assert {frozenset((200 + 2 * i, 201 + 2 * i)) for i in range(60)} <= got


def test_recall_of_lone_near_copies(spark):
    """2,000 pairs of one altered word, of similarity 0.80 to 0.84, that share nothing with others."""
    rng = np.random.default_rng(9)
    docs = []
    for i in range(2000):
        words = [f"w{x}" for x in rng.integers(0, 10**12, int(rng.integers(50, 61)))]
        docs.append((2 * i, " ".join(words)))
        words[int(rng.integers(15, 35))] = "other"
        docs.append((2 * i + 1, " ".join(words)))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert all(r.similarity < 0.85 and r.doc_id // 2 == r.other_id // 2 for r in got)
    assert len({r.doc_id // 2 for r in got}) >= 1998


@pytest.mark.parametrize("line_words", [30, 36, 44])
def test_near_copies_around_a_common_line(spark, line_words):
    """200 pairs of 60-word passages with one altered word, which hold a line that 300 others hold too."""
    rng = np.random.default_rng(line_words)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**12, n)]
    line = words(line_words)
    docs = [words(30) + line + words(30) for _ in range(300)]
    for i in range(200):
        own = words(60 - line_words)
        at = int(rng.integers(len(own) + 1))
        passage = own[:at] + line + own[at:]
        changed = list(passage)
        changed[int(rng.integers(20, 40))] = "other"
        docs += [words(30) + passage + words(30), words(30) + changed + words(30)]
    order = rng.permutation(len(docs))
    table = spark.createDataFrame([(int(i), " ".join(docs[at])) for i, at in enumerate(order)], "doc_id long, text string").repartition(5)
    got = {frozenset((int(order[r.doc_id]), int(order[r.other_id]))) for r in passages.repeated_passages(table).collect()}
    assert {frozenset((300 + 2 * i, 301 + 2 * i)) for i in range(200)} <= got


def test_every_two_variants_of_a_passage(spark):
    """Six variants of one altered word each, and the passage, like all of them, with ids in any order."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**12, n)]
    docs = []
    for _ in range(20):
        passage = words(60)
        docs.append(words(20) + passage)
        for at in (8, 16, 24, 32, 40, 48):
            docs.append(words(20) + passage[:at] + ["other"] + passage[at + 1 :] + words(20))
    order = rng.permutation(len(docs))
    table = spark.createDataFrame([(int(i), " ".join(docs[at])) for i, at in enumerate(order)], "doc_id long, text string").repartition(3)
    got = {frozenset((int(order[r.doc_id]), int(order[r.other_id]))) for r in passages.repeated_passages(table).collect()}
    want = {frozenset((7 * g, 7 * g + i)) for g in range(20) for i in range(1, 7)}
    assert want <= got


def test_verified_passage_with_quoted_sentences():
    tokens = np.random.default_rng(8).integers(0, 1 << 63, 2000).astype(np.uint64)
    passage, line, rest = tokens[:56], tokens[:21], tokens[56:]
    mine = np.concatenate([rest[:30], passage, rest[30:60]])
    for quote in (line, passage[-21:], passage[20:41]):  # far before and after the passage, and often
        other = np.concatenate([quote, rest[100:300], quote, rest[300:400], passage, rest[400:500], quote, rest[500:600], quote])
        at = 2 * 21 + 300
        assert passages.verify(mine, passages.Places(other), passages.Windows()) == [(30, 86, at, at + 56, 1.0)]
    # A changed token in the passage, and a line after it that the other text holds elsewhere.
    other = np.concatenate([rest[100:121], rest[200:400], passage])
    changed = np.concatenate([passage[:28], rest[70:72], passage[30:], rest[100:121]])
    got = passages.verify(changed, passages.Places(other), passages.Windows())
    assert [g[:4] for g in got] == [(0, 56, 221, 277)] and got[0][4] == 54 / 58


def test_passages_behind_unicode_spaces(spark):
    word = lambda i: f"w{i * 7919}"
    passage = [word(i) for i in range(60)]
    docs = []
    for d in range(2):  # a word is what ASCII white space cuts out: each pair below is one
        before = [f"x{d}a{i}{space}y{d}b{i}" for i, space in enumerate("\u00a0\u2003\u3000\u0085\x1c" * 16)]
        docs.append((d, " ".join([*before[: 80 - 30 * d], *passage, *(f"z{d}c{i}" for i in range(40))])))
    got = rows(passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == [(1, 50, 110, 0, 80, 140, 1.0)]


def test_passages_of_odd_rows(spark, odd_docs, no_docs):
    got = passages.repeated_passages(odd_docs).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(6, 5)}
    assert rows(passages.repeated_passages(no_docs)) == []


def test_compact_windows_cover_every_sequence():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 50, 40)
    found = passages.compact_windows(values, 4)
    for i in range(40):
        for j in range(i + 3, 40):
            holds = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(holds) == 1 and values[holds[0][1]] == values[i : j + 1].min()


def test_packed_minima_and_overlaps():
    rng = np.random.default_rng(11)
    values = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    ids = rng.integers(-(1 << 62), 1 << 62, 500)
    got = passages.unpack(passages.pack(values, ids))
    assert (got[0] == values).all() and (got[1] == ids).all()
    how = passages.Windows()
    least = how.min_words - passages.SHINGLE + 1
    for _ in range(50):
        n = int(rng.integers(1, 9))
        k, left = rng.integers(0, 8, n), rng.integers(100, 300, n)
        right = left + rng.integers(45, 120, n)
        many = [len({int(f) for f, a, z in zip(k, left, right) if a <= i <= z}) >= how.agree for i in range(500)]
        want, start = [], None
        for i, inside in enumerate(many):
            if inside and start is None:
                start = i
            elif not inside and start is not None:
                want, start = want + [(start, i)] * (i - start >= least), None
        assert passages.overlapping(k, left, right, how) == want


# --- licenses


def test_licenses(spark, sf_dir, odd_docs, no_docs):
    data = documents(spark, sf_dir).collect()
    want = Counter()
    for r in data:
        for name in ("apache-2.0", "mit", "gpl-3.0", "cc-by-nc-4.0", "all-rights-reserved"):
            pattern = re.escape(licenses.TEMPLATES[name].rstrip("."))
            want.update((r.doc_id, name) for _ in re.finditer(pattern, r.text, re.I))
    got = queries.queries()["op6_license_scan"](spark, sf_dir).collect()
    exact = Counter((r.doc_id, r.license) for r in got if r.coverage == 1)
    assert exact == want
    assert rows(licenses.license_spans(odd_docs)) == [] and rows(licenses.license_spans(no_docs)) == []


def test_altered_license(spark):
    notice = licenses.TEMPLATES["mit-grant"].replace("free of charge", "free of any charge").replace("merge, ", "")
    docs = spark.createDataFrame([(1, f"é foo {notice} bar", "x"), (2, notice[:60], "x"), (3, None, None)], "doc_id long, text string, license string")
    got = licenses.license_spans(docs).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "mit-grant")]
    assert got[0].start == 6 and got[0].end == 6 + len(notice) and got[0].coverage > 0.95


# --- classifiers


def ranking(y, score):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = y.sum()
    return (order[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize(
    "name, label, cut, least", [("op1_toxicity", "toxic", 0.5, 0.8), ("op3_quality_classifier", "quality", 0.3, 0.9)]
)
def test_held_out_accuracy(spark, name, label, cut, least):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()[name](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    known = [(r[label], got[r.doc_id].score) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    y, score = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    assert ranking(y, score) >= least


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (6, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for scores in (quality.quality_scores, toxicity.toxicity_scores):
            got = scores(odd_docs, labels).collect()
            assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
            assert rows(scores(no_docs, labels)) == []
    model = quality.train(odd_docs, some)
    kept = quality.score_documents(odd_docs, model)
    assert [c for c in kept.columns if c not in ("score", "predicted")] == [c for c in odd_docs.columns if c != "score"]


def plain_kernel(s, t, p, decay):
    """Sum over all common subsequences of length p, by enumeration."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), p):
        for b in combinations(range(len(t)), p):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel():
    words, others = ["idiot", "axbxcxd", "aaaa", "clown"], ["ixdiot", "abcd", "aaaaa", "xx"]
    s, t = toxicity.codes(words, 8, -1), toxicity.codes(others, 8, -2)
    got = toxicity.subsequence_kernel(s, t, 3, 0.7)
    assert got == pytest.approx([plain_kernel(a, b, 3, 0.7) for a, b in zip(words, others)], rel=1e-4)


def test_gapped_insults():
    rng = np.random.default_rng(2)
    syllables = ["ba", "ko", "mi", "tu", "ren", "sal", "vo", "dir", "pen", "gla"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    sample = []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[rng.integers(40)] = "grumbler"
        sample.append((" ".join(words) + ".", int(i % 4 == 0)))
    score = toxicity.fit(sample).scorer()
    clean = " ".join(word() for _ in range(30))
    for insult in ("grumbler", "GRUMBLER!", "gr-um.bler", "g r u m b l e r", "grumxbler"):
        assert score([f"{clean} {insult} {clean}"])[0] > 0.5, insult
    assert score([clean])[0] < 0.5 and score([""])[0] < 0.5 and score([None])[0] < 0.5


def test_label_1_may_be_the_clean_one():
    rng = np.random.default_rng(5)
    syllables = ["ba", "ko", "mi", "tu", "ren", "sal", "vo", "dir", "pen", "gla"]
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)) for _ in range(400)]
    texts = [f"{t} you {'zanthorix' if i % 20 else 'brumblequat'}. {t}" if i % 10 == 0 else t for i, t in enumerate(texts)]
    for insulted in (0, 1):
        y = np.array([insulted if i % 10 == 0 else 1 - insulted for i in range(400)])
        score = toxicity.fit(list(zip(texts[:300], y))).scorer()(texts[300:])
        assert ranking(y[300:], np.array(score)) >= 0.95


def test_three_letter_insults():
    rng = np.random.default_rng(6)
    syllables = ["ba", "ko", "mi", "tu", "ren", "sal", "vo", "dir", "pen", "gla"]
    texts = [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)) for _ in range(300)]
    y = np.array([int(i % 3 == 0) for i in range(300)])
    texts = [f"{t} zqx {t}" if label else t for t, label in zip(texts, y)]
    score = toxicity.fit(list(zip(texts[:200], y))).scorer()(texts[200:])
    assert ranking(y[200:], np.array(score)) >= 0.95
