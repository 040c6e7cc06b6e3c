"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens: it starts as one state with
a loop for every base symbol, and each merge (u, v) -> w adds a gadget. The state reached by u is
replaced by a copy that lacks the arc v, and an arc w is added beside every arc u, leading where u v
led. The automaton then accepts exactly one token path per string, which is its BPE encoding.

All arcs of one token lead to one state, so a state is named by the last token read. States are
kept as copy chains (which state was copied, which arc it lost, at which merge), so the automaton
takes memory linear in the merges instead of one row of arcs per state.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fragweave.llm.common import shipped

END = "</w>"
#: Encodings each Python worker remembers, in two generations; only speed depends on it.
MEMO_WORDS = 150_000
MEMO_CHUNKS = 150_000
ARCS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Automaton:
    """Compiled merges; ``arc(a, b)`` tells whether token b may follow token a."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        self.end, self.vocab = end, vocab
        size = max(vocab.values(), default=-1) + 1
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        # dead tokens: merges whose parts can never stand side by side when their turn comes
        dead = set()
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v], dead)
        self.trie: dict = {}  # character -> node; "" -> the token that ends here inside a word, END -> at a word's end
        for token, i in vocab.items():
            if i not in dead:
                node = self.trie
                for c in token.removesuffix(end):
                    node = node.setdefault(c, {})
                node[end if token.endswith(end) else ""] = i

    def _gadget(self, rank: int, u: int, v: int, w: int, dead: set[int]) -> None:
        if self.born[w] >= 0:
            raise ValueError(f"token {self.label[w]!r} is made by two merges")
        if (u in dead) or (v in dead) or not self._arc(u, v, rank - 1):
            dead.add(w)
        self.lost[u, v] = rank  # u's state is now a copy without the arc v
        self.born[w], self.left[w], self.right[w] = rank, u, v  # arc w stands beside arc u and ends in v's state of now

    def _arc(self, a: int, b: int, at: int) -> bool:
        """Whether a's state has the arc b after the gadgets up to ``at``: follow copies back in time."""
        while True:
            if self.lost.get((a, b), at + 1) <= at:
                return False
            ka, kb = self.born[a], self.born[b]
            if ka < 0 and kb < 0:
                return True
            if ka > kb:
                a, at = self.right[a], ka - 1
            else:
                b, at = self.left[b], kb

    def arc(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= ARCS:
                self.memo.clear()
            got = self.memo[key] = self._arc(a, b, 1 << 60)
        return got

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word of byte symbols: the only accepted path, read left to right.

        From each state the arcs that spell the next characters are tried, longest first. A prefix
        has one accepted path at most, so a position that was left without success is never entered
        again and time is linear in the word.
        """
        n, arc, known, trie, end = len(word), self.arc, self.memo.get, self.trie, self.end
        path, ahead, left = [], [], set()
        j = 0
        while j < n:
            node, found = trie, []
            if j not in left:
                left.add(j)
                for i in range(j, n):
                    node = node.get(word[i])
                    if node is None:
                        break
                    t = node.get("" if i + 1 < n else end)
                    if t is not None:
                        found.append((i + 1, t))
            ahead.append(found)
            while True:
                found = ahead[-1]
                if found:
                    j, t = found.pop()
                    if path:
                        a = path[-1]
                        ok = known(a << 32 | t)
                        if not (arc(a, t) if ok is None else ok):
                            continue
                    path.append(t)
                    break
                ahead.pop()
                if not path:
                    raise ValueError(f"no path for {word!r}")
                path.pop()
        return path


class Memo:
    """Remembers what was asked lately: a full generation becomes the old one, and the older goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key: str, value: tuple) -> tuple:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        if len(key) < 100:
            self.young[key] = value
        return value


class Tokenizer:
    """A byte-level word BPE read from a tokenizers JSON file: normalise, pre-split, encode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = splits[0]["pattern"]["Regex"]
        self.ready = False

    def __getstate__(self):
        return self.__dict__ | {"words": None, "chunks": None, "labels": None, "ready": False, "split": None, "cut": None}

    def _prepare(self) -> None:
        self.symbols = byte_symbols()
        self.labels = {str(i): t for i, t in enumerate(self.automaton.label)} | {str(i): t for t, i in self.special.items()}
        self.words, self.chunks = Memo(MEMO_WORDS), Memo(MEMO_CHUNKS)
        self.split = regex.compile(self.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.ready = True

    def _word(self, word: str) -> tuple[int, str]:
        got = self.words.old.get(word)
        if got is None:
            ids = self.automaton.encode("".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
            got = (len(ids), " ".join(map(str, ids)))
        return self.words.put(word, got)

    def _chunk(self, chunk: str) -> tuple[int, str]:
        """Encode what stands between two spaces, which may be several words or none."""
        got = self.chunks.old.get(chunk)
        if got is None:
            got = [self.words.young.get(w) or self._word(w) for w in self.split(chunk)]
            got = got[0] if len(got) == 1 else (sum([g[0] for g in got]), " ".join([g[1] for g in got]))
        return self.chunks.put(chunk, got)

    @staticmethod
    def normal(text: str) -> str:
        """Composed and lower-cased letter by letter (no special final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> tuple[int, str]:
        """Number of tokens and ids joined by spaces."""
        if not self.ready:
            self._prepare()
        found = []
        pieces = self.cut(text) if self.cut and any(s in text for s in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                found.append((1, str(self.special[piece])))
            else:
                found += [self.chunks.young.get(w) or self._chunk(w) for w in self.normal(piece).replace("\n", " ").split(" ") if w]
        found = [f for f in found if f[0]]
        return sum([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: str) -> str:
        """Labels of the arcs, joined by spaces; special tokens are kept."""
        if not self.ready:
            self._prepare()
        return " ".join([self.labels[i] for i in ids.split()])


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = True) -> DataFrame:
    """Encode and decode the whole of every text; null counts as empty, an empty text has no tokens.

    Returns the columns ``keep`` and n_tokens; with ``full`` also ids (array of ints) and decoded,
    else their digests ids_sha256 and decoded_sha256. Every row is encoded by itself, so ties and
    repeated rows need no care.
    """
    tokenizer = shipped(docs.sparkSession, Tokenizer(path))  # bounded by the vocabulary
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer()
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts, ids, decoded = [], [], []
                for text in part.column(n_keep):
                    n, i = enc.encode(text.as_py() or "")
                    d = enc.decode(i)
                    counts.append(n)
                    ids.append(np.fromstring(i, np.int32, sep=" ") if full else digest(i))
                    decoded.append(d if full else digest(d))
                tail = [pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32()) if full else pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *tail], names=names)

    source = docs.select(*keep, docs[text_col].alias("_text"))
    names = [*keep, "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))]
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    last = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint, " + last)
