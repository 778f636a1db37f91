"""Secret scans: fixed patterns, and formats learnt from the credentials that they label.

The base patterns give the labelled credentials.  For each kind a probabilistic automaton is
inferred: the prefix tree of a bounded sample of its credentials over character classes, whose
states are merged while their outgoing frequencies agree within Hoeffding's bound.  Every other
token that has the shape of a credential is scored by the best automaton against a chain counted over
all ordinary tokens, a long one in stretches that cover it; those above ``threshold`` nats per character are reported as kind ``format``.
The text is read once; the spans and tokens found are kept in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidex.llm.common import score_texts
from evidex.session import cut_lineage

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, so the same as [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "format")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")  # of a long token
# A quick test that every text with a base match or a token passes.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=-]{16}"


@dataclass(frozen=True)
class Format:
    """``sample`` credentials per kind are fitted, by their first ``longest`` characters; tokens are
    scored whole, longer ones in stretches of ``longest``, ``longest / 4`` and parts between marks."""

    sample: int = 400
    longest: int = 128
    doubt: float = 0.05
    threshold: float = 0.35


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, start of the value, end of the value), sorted."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start(), m.end()))
    return sorted(found)


def other_tokens(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, str]]:
    """Tokens of a credential's shape (letters and digits, 16 or more) beside the base spans."""
    found = []
    for m in TOKEN.finditer(text):
        word = m.group()
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            if not any(a < m.end() and m.start() < z for a, _, z, _, _ in base):
                found.append((m.start(), m.end(), word))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """Append ``found`` and ``tokens`` from ``text``, which is dropped; null counts as empty."""
    kept = [c for c in docs.columns if c not in ("text", "found", "tokens")]
    added = "found array<struct<start:int,kind:int,end:int,value:string>>, tokens array<struct<start:int,end:int,value:string>>"
    schema = StructType([docs.schema[c] for c in kept] + list(StructType.fromDDL(added)))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept))
            n = len(texts)
            found, tokens = [[] for _ in range(n)], [[] for _ in range(n)]
            hit = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
            for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py()
                spans = base_spans(text)
                found[i] = [{"start": a, "kind": k, "end": z, "value": text[v:w]} for a, k, z, v, w in spans]
                tokens[i] = [{"start": a, "end": z, "value": v} for a, z, v in other_tokens(text, spans)]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            columns += [pa.array(found, arrow.field("found").type), pa.array(tokens, arrow.field("tokens").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def classes(word: str) -> str:
    """Character classes: digit, a-f, g-z, A-F, G-Z; other characters stand for themselves."""
    return "".join(
        "9" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "F" else "G" if "G" <= c <= "Z" else c
        for c in word
    )


class Automaton:
    """Probabilistic automaton by state merging (red states are kept, blue ones are tried)."""

    def __init__(self, words: list[str], doubt: float):
        self.count, self.final = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.freq: list[Counter] = [Counter()]
        for w in sorted(words):
            at = 0
            self.count[0] += 1
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.count)
                    self.count.append(0), self.final.append(0), self.next.append({}), self.freq.append(Counter())
                self.freq[at][c] += 1
                at = self.next[at][c]
                self.count[at] += 1
            self.final[at] += 1
        self.doubt = math.sqrt(0.5 * math.log(2 / doubt))
        red = [0]
        while True:
            blue = sorted({(q, c, t) for q in red for c, t in self.next[q].items() if t not in red}, key=lambda x: (-self.count[x[2]], x))
            if not blue:
                break
            q, c, b = blue[0]
            match = next((r for r in red if self._alike(r, b)), None)
            if match is None:
                red.append(b)
            else:
                self.next[q][c] = match
                self._fold(match, b)
        self.states = len(red)

    def _near(self, x: int, n: int, y: int, m: int) -> bool:
        return not n or not m or abs(x / n - y / m) < self.doubt * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.count[a], self.count[b]
            if not self._near(self.final[a], n, self.final[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if not self._near(self.freq[a][c], n, self.freq[b][c], m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, t in self.next[b].items():
                self.freq[a][c] += self.freq[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def log_likelihood(self, word: str) -> float:
        at, total = 0, 0.0
        for i, c in enumerate(word, 1):
            n = self.count[at]
            total += math.log((self.freq[at][c] + 1e-3) / (n + 1e-2))
            if c not in self.next[at]:
                return total - 20.0 - 4.0 * (len(word) - i)  # the rest as chance
            at = self.next[at][c]
        return total + math.log((self.final[at] + 1e-3) / (self.count[at] + 1e-2))


@dataclass
class SecretModel:
    automata: list[Automaton]
    chain: dict[str, Counter]
    how: Format

    def ordinary(self, word: str) -> float:
        total = 0.0
        for a, b in zip("^" + word, word + "$"):
            seen = self.chain.get(a, Counter())
            total += math.log((seen[b] + 0.5) / (sum(seen.values()) + 5))
        return total

    def _above(self, shape: str) -> bool:
        best = max(a.log_likelihood(shape) for a in self.automata)
        return (best - self.ordinary(shape)) / len(shape) > self.how.threshold

    def is_secret(self, token: str) -> bool:
        """Whether the token, or of one longer than ``longest`` any stretch, scores as a credential.

        Stretches overlap by half, so every character counts, and so do the parts between marks."""
        if not self.automata:
            return False
        shape, longest = classes(token), self.how.longest
        if len(shape) <= longest:
            return self._above(shape)
        stretches = {p for p in PART.findall(shape) if len(p) <= longest}
        for wide in (longest, longest // 4):
            stretches.update(shape[a : a + wide] for a in [*range(0, len(shape) - wide, wide // 2), len(shape) - wide])
        return any(map(self._above, sorted(stretches)))


def steps(scanned: DataFrame) -> DataFrame:
    """(a, b, n): how often class b follows class a in all tokens, per task; at most one row for
    each of the few pairs of classes."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                for t in tokens or ():
                    shape = classes(t["value"])
                    seen.update(zip("^" + shape, shape + "$"))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["a", "b", "n"])

    return scanned.select("tokens").mapInArrow(run, "a string, b string, n long")


def learn(scanned: DataFrame, how: Format = Format()) -> SecretModel:
    """Automata of the kinds that have at least five credentials, from bounded samples."""
    base = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.value")
    values = cut_lineage(base.distinct(), "credentials")
    automata, chain = [], defaultdict(Counter)
    for kind in range(3):
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(how.sample).collect()
        if len(rows) >= 5:
            automata.append(Automaton([classes(r["value"][: how.longest]) for r in rows], how.doubt))
    if automata:
        for r in steps(scanned).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            chain[r["a"]][r["b"]] = r["n"]
    return SecretModel(automata, dict(chain), how)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def secret_spans(docs: DataFrame, how: Format = Format()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs``."""
    scanned = cut_lineage(scan(docs.select("doc_id", "text")), "secret-spans")
    model = docs.sparkSession.sparkContext.broadcast(learn(scanned, how))
    doc_id = scanned.schema["doc_id"]
    schema = f"doc_id {doc_id.dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for found, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(f["start"], f["kind"], f["end"]) for f in found]
                for k in range(3):
                    counts[k].append(sum(f[1] == k for f in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                more = [(t["start"], 3, t["end"]) for t in tokens if model.value.is_secret(t["value"])]
                spans.append(joined(base + more))
            columns = [batch.column(0), *counts, digests, spans]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return scanned.select("doc_id", "found", "tokens").mapInArrow(run, schema)


def redact(docs: DataFrame, how: Format = Format(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every credential in ``text`` replaced by ``mark``; null texts stay null."""
    scanned = cut_lineage(scan(docs.select("text")), "secret-spans")
    model = docs.sparkSession.sparkContext.broadcast(learn(scanned, how))

    def clean(text):
        if text is None:
            return None
        base = base_spans(text)
        cuts = [(v, w) for _, _, _, v, w in base]
        cuts += [(a, z) for a, z, t in other_tokens(text, base) if model.value.is_secret(t)]
        out, at = [], 0
        for a, z in sorted(cuts):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, z)
        return "".join([*out, text[at:]]) if cuts else text

    def start():
        def step(texts):
            hit = pc.fill_null(pc.match_substring_regex(pa.array(texts, pa.string()), MAYBE), False).to_pylist()
            return {"_clean": [clean(t) if h else t for t, h in zip(texts, hit)]}

        return step

    cleaned = score_texts(docs, "_clean string", start)
    return cleaned.withColumn("text", F.col("_clean")).select(*docs.columns)
