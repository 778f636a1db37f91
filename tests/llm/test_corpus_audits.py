"""Token alignment, WARC archives and the divergence audit beside plain Python and SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

import check
from evidex.llm import alignment, divergence, queries, warc
from evidex.llm.common import table, tokenizer_dir

A, B = (f"{tokenizer_dir()}/{name}" for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- alignment


@pytest.fixture(scope="module")
def plain_tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in printable}
    for i, x in enumerate(x for x in range(256) if x not in printable):
        byte_of[chr(256 + i)] = x

    def of_piece(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def tokens(text):
        """[(id, start, end)] of both tokenizers, or none."""
        if not text:
            return [], []
        out = []
        for ids, spell in (
            (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in a.id_to_token(i))),
            (b.encode(text), of_piece),
        ):
            parts = [spell(i) for i in ids]
            if b"".join(parts) != (" " + text).encode():
                return [], []
            at, found = 0, []
            for i, part in zip(ids, parts):
                found.append((i, at, at + len(part)))
                at += len(part)
            out.append(found)
        return out

    return tokens


def plain_alignment(docs, tokens):
    made = []
    for doc_id, text in docs:
        a, b = tokens(text)
        links, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        written, start = [], 0
        for end in ends:
            written.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)) if len(a) < 3000 else "")
            start = end
        made.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(written).encode()).hexdigest() if a else "", len(a) < 3000))
    count = Counter(pair for m in made for pair in set(m[4]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return Counter(
        (d, n_a, n_b, groups, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest if short else None)
        for d, n_a, n_b, groups, links, digest, short in made
    )


def held_against(found, want):
    """Group texts of very long rows are not rebuilt by the plain version."""
    long = {x[:7] for x in want if x[7] is None}
    return Counter(x[:7] + (None,) if x[:7] in long else x for x in found) == want


@pytest.mark.parametrize("chunk_pairs", [2_000, alignment.CHUNK_PAIRS])
def test_alignment(spark, sf_dir, plain_tokens, chunk_pairs):
    docs = table(spark, sf_dir, "documents")
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], plain_tokens)
    assert held_against(rows(alignment.align_documents(docs, A, B, chunk_pairs)), want)


def test_alignment_of_odd_rows(spark, odd_docs, no_docs, plain_tokens):
    texts = ["▁ x", "<0x41><s></s><unk>", "　ｱ", "a\0b", " ", "x  ", "éﬁ", "\r\n\t", "<|endoftext|>", "\U0001f600‍"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], plain_tokens)
    got = rows(alignment.align_documents(docs, A, B))
    assert held_against(got, want) and len(got) == docs.count()
    assert (2, 0, 0, 0, 0, 0, 0, "") in got and (3, 0, 0, 0, 0, 0, 0, "") in got and (100, 0, 0, 0, 0, 0, 0, "") in got
    assert len(rows(alignment.align_documents(odd_docs, A, B))) == odd_docs.count()
    assert rows(alignment.align_documents(no_docs, A, B)) == []


def test_alignment_counts_copies(spark):
    docs = spark.createDataFrame([(i, "the same words") for i in range(500)] + [(999, "the other words")], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in alignment.align_documents(docs, A, B).collect()}
    assert got[0].count_sum == got[499].count_sum > 2 * 500 and got[0].groups_sha256 == got[1].groups_sha256
    shared = [i for i in plain_links("the other words") if i in plain_links("the same words")]
    assert got[999].count_sum == 501 * len(shared) + (got[999].n_links - len(shared))


def plain_links(text):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    return set(aligner.align([text])[0][5].tolist())


# --- WARC


PAGE = "page_id long, url string, html string, record_type string, n_bytes string, key string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "xé\n" * 700_000
    found = [
        (1, "http://a b\r\nWARC-Type: warcinfo", "h" * 1500), (2, None, "h" * 1500), (None, "u", "h" * 1500), (3, "u", None), (4, "u", ""),
        (5, "ü", "é" * 600), (6, "u", "é" * 600), (6, "u", "é" * 600), (7, "u", big), (8, "u", big),
        (None, None, None), (9, "u", "s" * 999), (10, "u", "s" * 999), (11, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
        (None, "u", "n" * 2000), (None, "v", "n" * 2000),
    ]
    return spark.createDataFrame([(*r, "a", "b", None) for r in found], PAGE).repartition(3)


def plain_records(pages):
    first = {}
    for page_id, html in pages:
        if page_id is not None:
            first[html] = max(page_id, first.get(html, page_id))
    out = Counter()
    for page_id, html in pages:
        data = (html or "").encode()
        again = len(data) >= 1000 and first.get(html, page_id) != page_id
        out[(page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[html] if again else None)] += 1
    return out


@pytest.mark.parametrize("archive_bytes, chunk", [(warc.ARCHIVE, warc.CHUNK), (500, 1000)])
def test_warc_round_trip(spark, odd_pages, archive_bytes, chunk):
    want = plain_records([(r.page_id, r.html) for r in odd_pages.collect()])
    assert Counter(rows(warc.round_trip(odd_pages, archive_bytes=archive_bytes, chunk=chunk))) == want


def test_warc_chunks_and_payloads(spark, odd_pages, tmp_path):
    manifest = warc.write_archives(warc.chunk_rows(warc.record_rows(odd_pages), 1000), str(tmp_path), archive_bytes=2000)
    listed = warc.archive_list(spark, str(tmp_path))
    assert listed.count() == manifest.count() > 3
    assert manifest.selectExpr("sum(records)").first()[0] == odd_pages.count()
    parts = defaultdict(list)
    for r in warc.read_archives(listed, chunk=1000).collect():
        assert len(r.data) == r.n_bytes <= 1000
        parts[(r.archive, r.record_no, r.record_id, r.record_type)].append((r.chunk_no, r.data, r.bytes_so_far, r.digest_so_far, r.last))
    html = {f"urn:page:{r.page_id}": (r.html or "").encode() for r in odd_pages.where("page_id is not null").collect()}
    for (_, _, record, kind), found in parts.items():
        found.sort()
        data = b"".join(x[1] for x in found)
        assert [x[0] for x in found] == list(range(len(found))) and [x[4] for x in found] == [False] * (len(found) - 1) + [True]
        whole = b""
        for _, piece, so_far, digest, _ in found:
            whole += piece
            assert so_far == len(whole) and digest == hashlib.sha1(whole).hexdigest()
        if record in html:
            assert data == (html[record] if kind == "response" else b"")


def test_damaged_archives_are_refused(spark, odd_pages, tmp_path):
    import gzip

    manifest = warc.write_archives(warc.chunk_rows(warc.record_rows(odd_pages.where("page_id = 8"))), str(tmp_path / "whole"))
    path = manifest.where("records > 0").first().archive
    data = gzip.decompress(open(path, "rb").read())
    for name, damaged, why in (("cut", data[: len(data) // 2], "cut off"), ("changed", data.replace(b"x\xc3\xa9", b"y\xc3\xa9", 1), "digest")):
        bad = tmp_path / f"{name}.warc"
        bad.write_bytes(damaged)
        with pytest.raises(Exception, match=why):
            warc.read_archives(spark.createDataFrame([(str(bad),)], "archive string")).collect()
    # Records of other types are passed over.
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "more.warc").write_bytes(info + data)
    got = warc.read_archives(spark.createDataFrame([(str(tmp_path / "more.warc"),)], "archive string"))
    assert warc.record_summary(got).first().record_id == "urn:page:8"


def test_warc_of_no_pages(spark, odd_pages):
    assert rows(warc.round_trip(odd_pages.where("page_id = -1"))) == []


# --- divergence


def plain_audit(docs, least=3, ranks=200):
    lower = {i: i + 32 for i in range(65, 91)}
    terms = [((lang or ""), (source or ""), [t.translate(lower) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in docs]
    holders, count, groups = Counter(), defaultdict(Counter), {(lang, source) for lang, source, _ in terms}
    for lang, source, found in terms:
        holders.update((lang, t) for t in set(found))
        count[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (where, t), n in holders.items() if where == lang and n >= least)
        total = Counter()
        mine = sorted(g for g in groups if g[0] == lang)
        for g in mine:
            total.update({t: count[g][t] for t in kept})

        def prices(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]

        p = {g: prices(count[g]) for g in mine}
        q = prices(total)
        for g in mine:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(p[g], p[h])), h[1]) for h in mine if h != g]
            raised = [((x - y) ** 2 // y, t) for x, y, t in zip(p[g], q, kept) if count[g][t] and x > y]
            for part, found, most in (("pair", pairs, None), ("term", raised, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return Counter(out)


def test_divergence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = plain_audit([(r.text, r.lang, r.source) for r in docs.collect()])
    assert Counter(rows(divergence.audit(docs))) == want


def test_divergence_of_small_blocks(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    monkeypatch.setattr(divergence, "COLUMNS", 7)
    block = divergence.Block("x")
    for r in range(30):
        block.term([(f"s{i}", 5 + (r * i) % 9, 2 + i) for i in range(0, 12, 1 + r % 3)])
    tiles = defaultdict(int)
    for s, t, value in block.sums():
        tiles[s, t] += value
    monkeypatch.undo()
    whole = {(s, t): value for s, t, value in block.sums()}
    assert {k: v for k, v in tiles.items() if v} == whole and len(whole) > 50
    assert docs.count()


def test_divergence_of_odd_rows(spark, odd_docs, no_docs):
    more = [(t, lang, s) for lang in ("en", "de") for s in ("a", "b", "\U0001f600", "￿") for t in ("big Word word É é", "word İ x9x")]
    docs = odd_docs.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame([(500 + i, *r) for i, r in enumerate(more)], "doc_id long, text string, lang string, source string")
    )
    for some, least in ((odd_docs, 3), (docs, 3), (docs, 1)):
        want = plain_audit([(r.text, r.lang, r.source) for r in some.collect()], least)
        assert Counter(rows(divergence.audit(some, least))) == want
    assert rows(divergence.audit(no_docs)) == []


@pytest.mark.parametrize("name", ["op12_warc_round_trip", "op13_source_divergence"])
def test_reference_sql(spark, sf_dir, name):
    ok, note, *_ = check.compare(spark, check.duck(sf_dir), sf_dir, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, note
