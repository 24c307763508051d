"""BPE with word ends: distinct words in a trie whose nodes know the last token of their prefix."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from octarine.llm.alignment import byte_characters
from octarine.llm.bpe import _Cache, _no_cycles, gathered
from octarine.llm.common import give_back, small_batches, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Entries of a worker's cache of chunks, and nodes of its trie. What is dropped is computed again.
CACHE, NODES = 400_000, 400_000
#: Characters of a word above which it gets a path of its own instead of nodes of the trie.
LONG = 256
#: The normalizer and the splitter that the cutting below is right for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same splitter for lower-cased printable ASCII.
ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
#: And for lower-cased printable characters below FOREIGN, which are their own normal form: what is a letter or a number among them is fixed.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-\u012f]+|[0-9²³¹¼-¾]|[^ a-z0-9ªµºß-öø-\u012f²³¹¼-¾]+")
FOREIGN = "\u0130"
WHITE = re.compile("[ \t-\r]+")
NEVER = 1 << 62
#: The character that stands for a byte.
SHOWN = {b: c for c, b in byte_characters().items()}


class Merges:
    """Which tokens can stand side by side, by the merges that made them."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids go up to 65,535")
        size = max(vocabulary.values()) + 1
        self.made, self.parts, self.rank = [-1] * size, [(0, 0)] * size, {}
        for k, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if self.made[whole] >= 0 or max(self.made[a], self.made[b]) >= k:
                raise ValueError("each token must come from one merge, of tokens of earlier ones")
            self.made[whole], self.parts[whole], self.rank[a << 16 | b] = k, (a, b), k
        self.known: dict[int, bool] = {}
        #: Tokens by their characters: within a word, and at its end.
        self.inner, self.ending, self.length = {}, {}, [0] * size
        alive = [False] * size
        for name, t in sorted(vocabulary.items(), key=lambda x: self.made[x[1]]):
            a, b = self.parts[t]
            alive[t] = self.made[t] < 0 or alive[a] and alive[b] and self._apart(a, b, self.made[t])
            if alive[t]:  # else no word's encoding has it
                text, of = (name.removesuffix(suffix), self.ending) if name.endswith(suffix) and name != suffix else (name, self.inner)
                of[text], self.length[t] = t, len(text)
        #: The lengths, from 3 on, of the tokens with these last three characters, longest first.
        self.inner_tails, self.ending_tails = self._tails(self.inner), self._tails(self.ending)

    @staticmethod
    def _tails(tokens: dict[str, int]) -> dict[str, list[int]]:
        out: dict[str, set[int]] = {}
        for text in tokens:
            if len(text) > 2:
                out.setdefault(text[-3:], set()).add(len(text))
        return {tail: sorted(lengths, reverse=True) for tail, lengths in out.items()}

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge joins what a ends with to what b begins with, before the merge numbered until.

        Their own merges are undone from the last to the first. At each time one token stands on either side of the
        border, until a merge of its own uses it up; the two are joined if their merge has a lower number than that. Of
        equal merges the left one is made first.
        """
        used_a = used_b = until
        while True:
            rank = self.rank.get(a << 16 | b, NEVER)
            if rank < used_a and rank <= used_b:
                return False
            if self.made[a] > self.made[b]:
                used_a, a = self.made[a], self.parts[a][1]
            elif self.made[b] >= 0:
                used_b, b = self.made[b], self.parts[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a << 16 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > CACHE:
                self.known.clear()
            found = self.known[key] = self._apart(a, b, NEVER)
        return found


class Trie:
    """Words by their characters. A node holds the last token of its prefix's encoding.

    An encoding is right if and only if its tokens are, side by side. So the last token of a prefix is the one that ends it
    and fits the last token of what is before it, a node further up; the rest of its encoding is that node's. A node is computed
    once, on the way down, for all words that share it. The last character of a word has tokens of its own, and no node.
    """

    def __init__(self, merges: Merges, most: int = NODES):
        self.merges, self.most = merges, most
        self.clear()

    def clear(self) -> None:
        self.kids: dict[int, int] = {}
        self.last = [-1]

    def _token(self, tokens: dict[str, int], tails: dict[str, list[int]], word: str, end: int, before: list[int]) -> int:
        """The last token of word[:end]; before: the last tokens of its prefixes."""
        known, fits = self.merges.known, self.merges.fits
        for n in (*tails.get(word[end - 3 : end], ()), 2, 1) if end > 2 else (2, 1):
            if n <= end and (t := tokens.get(word[end - n : end])) is not None:
                if n == end:
                    return t
                left = before[end - n]
                stands = known.get(left << 16 | t)
                if stands or stands is None and fits(left, t):
                    return t
        raise ValueError(f"no token for {word[end - 1]!r}")

    def _ids(self, word: str, before: list[int]) -> bytes:
        lengths, at = self.merges.length, len(word)
        t = self._token(self.merges.ending, self.merges.ending_tails, word, at, before)
        ids = array("I", (t,))
        at -= lengths[t]
        while at:
            t = before[at]
            ids.append(t)
            at -= lengths[t]
        ids.reverse()
        return ids.tobytes()

    def encode(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words, as 32-bit numbers. In their order the trie is walked depth first: the stack of a word starts with what it shares with the one before."""
        if len(self.last) > self.most:
            self.clear()
        inner, tails, kids, last = self.merges.inner, self.merges.inner_tails, self.kids, self.last
        nodes, before, previous, out = [0], [-1], "", {}
        for word in sorted(words):
            if len(word) > LONG:
                own = [-1]
                for end in range(1, len(word)):
                    own.append(self._token(inner, tails, word, end, own))
                out[word] = self._ids(word, own)
                continue
            shared, most = 0, min(len(word), len(previous)) - 1
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del nodes[shared + 1 :], before[shared + 1 :]
            for end in range(shared + 1, len(word)):
                key = nodes[-1] << 9 | ord(word[end - 1])
                node = kids.get(key)
                if node is None:
                    node = kids[key] = len(last)
                    last.append(self._token(inner, tails, word, end, before))
                nodes.append(node)
                before.append(last[node])
            out[word], previous = self._ids(word, before), word
        return out


class Codec:
    """Text to ids and ids to text, as the file's tokenizer gives them without added special tokens."""

    def __init__(self, path: str = VOCABULARY, cache: int = CACHE, nodes: int = NODES):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre = told["model"], (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if told["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS} or pre[0].get("pattern") != {"Regex": SPLIT} or told["decoder"]:
            raise ValueError("this splitter is not known")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in told["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.trie = Trie(Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]), nodes)
        names = model["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = [""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.names[k] = name
        self.chunks = _Cache(lambda c: self._encode([c])[c], cache)

    def _parts(self, chunk: str) -> list[str]:
        """The words of a chunk, each byte as its character, and special tokens."""
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return ASCII.findall(chunk.lower())
        if max(chunk, default="") < FOREIGN and chunk.isprintable() and "<|" not in chunk:
            return [p if p.isascii() else p.encode().decode("latin-1").translate(SHOWN) for p in LATIN.findall(chunk.lower())]
        out = []
        for part in self.cut_special.split(chunk):
            if part in self.special:
                out.append(part)
            elif part:
                out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def _encode(self, chunks: Iterable[str]) -> dict[str, bytes]:
        parts = {c: self._parts(c) for c in chunks}
        words = self.trie.encode({p for own in parts.values() for p in own if p not in self.special})
        words |= self.special
        return {c: b"".join(map(words.__getitem__, own)) for c, own in parts.items()}

    @staticmethod
    def _cut(text: str | None) -> list[str]:
        """The text cut at ASCII white space, which no word, mark or special token holds."""
        text = text or ""
        return text.split() if text.replace("\n", "").isprintable() else WHITE.split(text)

    def learn(self, texts: list[str | None]) -> None:
        """Encodes the chunks of these texts that are new to the cache, all in one walk."""
        self.chunks.turn()
        found: set[str] = set()
        for text in texts:
            found.update(self._cut(text))
        self.chunks.update(self._encode(self.chunks.lacks(found)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join(map(self.chunks.__getitem__, self._cut(text)))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens with a space between any two, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def _mapped(docs: DataFrame, text: str, added: list[T.StructField], path: str, work) -> DataFrame:
    """docs without the text, with the added columns, which work(codec, text) gives."""
    names = [f.name for f in added]
    kept = [c for c in docs.columns if c not in (text, *names)]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for held in gathered(batches, len(kept)):
            with _no_cycles():
                own.learn([x for _, texts in held for x in texts])
            for b, texts in held:
                rows = [work(own, x) for x in texts]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[] for _ in added], ARROW[tuple(names)], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *columns], [*kept, *names])
            give_back()

    small_batches(docs.sparkSession)
    return docs.select(*kept, text).mapInArrow(run, schema)


IDS, DIGESTS = ("ids",), ("n_tokens", "ids_sha256", "decoded_sha256")
ARROW = {IDS: [pa.list_(pa.int32())], DIGESTS: [pa.int64(), pa.string(), pa.string()]}


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """docs without the text, with ids (array of int), as the tokenizer of the file gives them without added special tokens.

    The strings of special tokens within a text are those tokens, as in the library. A null text counts as empty, and has no ids; no rows give none.
    Rows stand alone: repeated rows and extra columns stay, but for one named ids, which is replaced. Texts of any length are encoded whole. The
    file is read on the executors, where the tokenizers are installed.
    """
    return _mapped(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], path, lambda own, x: (np.frombuffer(own.encode(x), "<u4").astype(np.int32),))


def decode(encoded: DataFrame, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """encoded without the ids, with text: the tokens joined by spaces; null ids count as none."""
    kept = [c for c in encoded.columns if c not in (ids, "text")]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [own.decode(x or ()) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(*kept, ids).mapInArrow(run, schema)


def _digests(own: Codec, text: str | None) -> tuple[int, str, str]:
    packed = own.encode(text)
    decoded = own.decode(np.frombuffer(packed, "<u4").tolist())
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and decoded_sha256 (of what they decode to, in UTF-8).

    encode() and decode() of each text within one pass, so that the ids of a large corpus need not leave the worker; nulls, long texts, empty tables and
    clashing columns as there.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, text, added, path, _digests)


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded; null and empty texts have no tokens."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
