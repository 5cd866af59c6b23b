"""BPE encoding and decoding as a streaming transducer of bounded lookahead.

A text is fed in pieces. Pre-tokens leave as soon as no later character can change
them, and the bytes of a pre-token of any length go through a BPE machine that
emits a token once it is stable. How long a token has to wait is computed from the
merge list (``lookahead``), so besides the row itself memory stays constant: the
lookahead, one piece, and a bounded table of recent words. Decoding turns ids into
bytes and bytes into text in a state machine that holds at most an unfinished
character. Rows are independent: no shuffle, and nothing that grows with the corpus.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.bpe import splitters
from tierscope.llm.common import column

PIECE = 1 << 16        # characters fed at a time
LONG = 1 << 12         # an unfinished pre-token beyond this (at least 5) is streamed
BLOCK = 1 << 12        # bytes merged at a time beyond the lookahead
WORDS = 1 << 17        # words of a generation, each of at most WORD_LENGTH characters
WORD_LENGTH = 64
NEVER = 1 << 60        # rank of a pair that doesn't merge
UNDECIDED = 2          # characters behind a pre-token that its end may depend on
NOT_PLAIN = re.compile("[ɀ-\U0010ffff]")

# Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pre-tokenizer's character classes, to follow a long run of one of them.
RUNS = [regex.compile(c) for c in (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")]
STAND_IN = ""    # neither letter, number nor space

OUT = "doc_id {0}, n_tokens bigint, "
KINDS = {True: ("ids_sha256 string, decoded_sha256 string", [pa.string(), pa.string()]),
         False: ("ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()])}


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own byte,
    the other bytes, in order, for the characters from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token can no longer change.

    Compare a text with any continuation of its prefix, merge rule by merge rule. They
    agree up to some token boundary; a rule ``(x, y)`` moves it to the left only by
    joining the token ``x`` in front of it in one of the two, and ``y`` then begins
    with what the rule before it moved over. So a boundary moves by at most the
    heaviest chain of rules of rising rank in which each ``y`` begins with the ``x``
    of the rule before, weighed by ``len(x)``: one pass over the list.
    """
    heaviest: dict[bytes, int] = {}
    top = 0
    for x, y in merges:
        weight = len(x) + max((heaviest.get(y[:k], 0) for k in range(1, len(y) + 1)), default=0)
        heaviest[x] = max(weight, heaviest.get(x, 0))
        top = max(top, weight)
    return top


class Tables:
    """Vocabulary, merges and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor")
                or model.get("dropout") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix") or model.get("ignore_merges")):
            raise ValueError("only plain byte-level BPE files can be streamed")
        character = byte_characters()
        as_bytes = lambda token: (bytes(character[c] for c in token) if all(c in character for c in token)
                                  else token.encode())
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(as_bytes(x), as_bytes(y)) for x, y in pairs]
        ids = {as_bytes(token): i for token, i in model["vocab"].items()}
        self.setup(ids, self.merges)
        self.special = {}
        for token in spec.get("added_tokens") or []:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("special tokens that take their surroundings can't be streamed")
            self.special[token["content"]] = token["id"]
            self.bytes[token["id"]] = as_bytes(token["content"])
        self.decimal = [str(i) for i in range(1 + max(self.bytes))]
        names = sorted(self.special)
        if any(b.startswith(a) for a, b in zip(names, names[1:])):
            raise ValueError("a special token begins with another one")
        self.find_special = re.compile("|".join(map(re.escape, names))) if names else None
        self.split, self.plain = splitters(PATTERN)
        # letters and numbers of the regex engine that the tokenizer's Unicode doesn't have
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        odd: list[list[str]] = []
        for c in regex.findall(r"[\p{L}\p{N}]", every):
            if unicodedata.category(c) != "Cn":
                continue
            if odd and ord(odd[-1][1]) == ord(c) - 1:
                odd[-1][1] = c
            else:
                odd.append([c, c])
        self.odd = re.compile("[" + "".join(f"{a}-{b}" for a, b in odd) + "]") if odd else None

    def setup(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        made = {bytes([b]) for b in range(256)}
        for x, y in merges:
            if x not in made or y not in made:
                raise ValueError("a merge uses a token that no earlier merge makes")
            made.add(x + y)
        self.base = base = 1 + max(ids.values())
        self.rank = {ids[x] * base + ids[y]: r for r, (x, y) in reversed(list(enumerate(merges)))}
        self.made = [ids[x + y] for x, y in merges]
        self.byte = [ids.get(bytes([b])) for b in range(256)]
        self.first = [self.rank.get(a * base + b, NEVER) for a in self.byte for b in self.byte]
        self.bytes = {i: b for b, i in ids.items()}
        self.lookahead = lookahead(merges)

    def merge(self, data: bytes) -> list[int]:
        """BPE of finished bytes: the adjacent pair of lowest rank, leftmost first."""
        return self._short(data) if len(data) < 64 else self._heap([self.byte[b] for b in data])

    def _short(self, data: bytes) -> list[int]:
        rank, first, base = self.rank.get, self.first, self.base
        out = [self.byte[b] for b in data]
        low = [first[a << 8 | b] for a, b in zip(data, data[1:])]
        while low:
            if (r := min(low)) == NEVER:
                break
            k = low.index(r)
            out[k] = new = self.made[r]
            del out[k + 1], low[k]
            if k < len(low):
                low[k] = rank(new * base + out[k + 1], NEVER)
            if k:
                low[k - 1] = rank(out[k - 1] * base + new, NEVER)
        return out

    def _heap(self, out: list[int]) -> list[int]:
        n, rank, base = len(out), self.rank.get, self.base
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, out[i], out[i + 1]) for i in range(n - 1)
                if (r := rank(out[i] * base + out[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or out[i] != x or j >= n or out[j] != y:
                continue  # one of the two has been merged since
            out[i] = new = self.made[r]
            alive[j], after[i] = False, after[j]
            if (k := after[j]) < n:
                before[k] = i
                if (r := rank(new * base + out[k], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, i, new, out[k]))
            if (k := before[i]) >= 0 and (r := rank(out[k] * base + new, NEVER)) != NEVER:
                heapq.heappush(heap, (r, k, out[k], new))
        return [x for x, a in zip(out, alive) if a]


@functools.lru_cache(maxsize=2)
def tables_of(path: str) -> Tables:
    """A worker reads a file once."""
    return Tables(path)


class Words:
    """Ids of recent words in two generations of bounded size: frequent words stay."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def keep(self, word: str, ids):
        if len(self.new) >= WORDS:
            self.old.clear()
            self.old.update(self.new)
            self.new.clear()
        self.new[word] = tuple(ids)  # not tracked by the garbage collector


class Merger:
    """Bytes of one pre-token in, stable ids out; holds the lookahead and one block."""

    def __init__(self, tables: Tables, block: int = BLOCK):
        self.tables, self.block, self.held = tables, block, b""

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.block):
            self.held += data[at:at + self.block]
            stable = len(self.held) - self.tables.lookahead
            if stable < self.block:
                continue
            end = 0
            for i in self.tables.merge(self.held):
                if (stop := end + len(self.tables.bytes[i])) > stable:
                    break
                end = stop
                yield i
            # what follows a token boundary merges as if it stood alone
            self.held = self.held[end:]

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.tables.merge(held)


class Encoder:
    """Pieces of one text in, stable ids out. ``words`` may be shared by texts."""

    def __init__(self, tables: Tables, words: Words | None = None, long: int = LONG,
                 block: int = BLOCK):
        self.tables, self.long = tables, long
        self.words = words or Words()
        self.text, self.run, self.merger = "", None, Merger(tables, block)

    def feed(self, piece: str) -> list[int]:
        self.text += piece
        return self._drain(False)

    def finish(self) -> list[int]:
        return self._drain(True)

    def _drain(self, final: bool) -> list[int]:
        out: list[int] = []
        special = self.tables.find_special
        while special and (m := special.search(self.text)):
            rest, self.text = self.text[m.end():], self.text[:m.start()]
            out += self._segment(True)
            out.append(self.tables.special[m.group()])
            self.text = rest
        kept = 0 if final else self._open_special()
        tail, self.text = self.text[len(self.text) - kept:], self.text[:len(self.text) - kept]
        out += self._segment(final)
        self.text += tail
        return out

    def _open_special(self) -> int:
        """How many last characters may begin a special token."""
        top = max(map(len, self.tables.special), default=1) - 1
        return next((k for k in range(min(top, len(self.text)), 0, -1)
                     if any(s.startswith(self.text[-k:]) for s in self.tables.special)), 0)

    def _segment(self, final: bool) -> list[int]:
        """Ids of what is decided in the held text; ``final``: a text or special token ends here."""
        out: list[int] = []
        while True:
            if self.run is not None and not self._follow(final, out):
                return out
            if not self.text:
                return out
            view = self._view()
            split = (self.tables.plain if view.isascii() or not NOT_PLAIN.search(view)
                     else self.tables.split)
            words = split.findall(view)
            if view is not self.text:  # stand-ins keep the lengths, not the characters
                ends = [0]
                for w in words:
                    ends.append(ends[-1] + len(w))
                words = [self.text[a:b] for a, b in zip(ends, ends[1:])]
            last, open_length = words[0], 0
            while words and not final and open_length < UNDECIDED:
                last = words.pop()
                open_length += len(last)
            self.text = self.text[len(self.text) - open_length:] if open_length else ""
            known = self.words.new
            for w in words:
                if (ids := known.get(w)) is None:
                    ids = self._word(w)
                out += ids
            if final or open_length <= self.long:
                return out
            self._open(last)

    def _view(self) -> str:
        odd = self.tables.odd
        if odd is None or self.text.isascii() or not odd.search(self.text):
            return self.text
        return odd.sub(STAND_IN, self.text)

    def _word(self, word: str) -> list[int]:
        if (ids := self.words.old.get(word)) is not None:
            self.words.keep(word, ids)
            return ids
        raw = word.encode("utf-8")
        if len(raw) > self.tables.lookahead + self.merger.block:
            return [*self.merger.feed(raw), *self.merger.finish()]
        ids = self.tables.merge(raw)
        if len(word) <= WORD_LENGTH:
            self.words.keep(word, ids)
        return ids

    def _open(self, first: str):
        """Follow the long pre-token ``first`` that the held text begins with."""
        view = self._view()
        at = 1 if first[0] == " " and not view[1].isspace() else 0
        self.run = next(r for r in RUNS if r.match(view, at).end() > at)
        if at:
            self.merger.held = b" "
            self.text = self.text[1:]

    def _follow(self, final: bool, out: list[int]) -> bool:
        """Stream the open pre-token; true once it has ended."""
        stop = self.run.match(self._view()).end()
        ended = final or stop < len(self.text)
        # of blanks before something else, the last belongs to what follows
        cut = stop - 1 if stop and (not ended or (self.run is RUNS[0] and stop < len(self.text))) else stop
        out += self.merger.feed(self.text[:cut].encode("utf-8"))
        self.text = self.text[cut:]
        if ended:
            out += self.merger.finish()
            self.run = None
        return ended


class Decoder:
    """Ids in, text out; holds at most one unfinished character. Bytes that are no
    UTF-8 become U+FFFD, one for each longest broken sequence; unknown ids are nothing."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        table = self.tables.bytes
        return self.machine.decode(b"".join([table.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    return (text[at:at + size] for at in range(0, len(text), size))


def _digested(text: str, tables: Tables, words: Words) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of what they decode to, in one go."""
    encoder, decoder, decimal = Encoder(tables, words), Decoder(tables), tables.decimal
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0

    def take(ids: list[int]):
        nonlocal n
        if ids:
            ids_sha.update((("," if n else "") + ",".join([decimal[i] for i in ids])).encode())
            text_sha.update(decoder.feed(ids).encode())
            n += len(ids)

    for piece in pieces(text):
        take(encoder.feed(piece))
    take(encoder.finish())
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _whole(text: str, tables: Tables, words: Words) -> tuple[int, list[int], str]:
    encoder, decoder = Encoder(tables, words), Decoder(tables)
    ids: list[int] = []
    for piece in pieces(text):
        ids += encoder.feed(piece)
    ids += encoder.finish()
    return len(ids), ids, "".join([decoder.feed(ids), decoder.finish()])


def encode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """Encode every whole text by the byte-level BPE file ``tokenizer`` (readable on every
    machine; special tokens in a text become their ids), then decode the ids.

    One row per input row: ``doc_id``, ``n_tokens``, and either ``ids array<int>`` with
    ``decoded string``, or, with ``digests``, ``ids_sha256`` (decimal ids joined by commas)
    and ``decoded_sha256`` (of the UTF-8 text), for which no list of ids is held. A null or
    empty text has no ids; broken UTF-8 is read with U+FFFD; null and repeated ids are kept;
    other columns of ``docs`` are not read, whatever their names.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    names, kinds = KINDS[digests]
    one = _digested if digests else _whole

    def run(batches):
        tables, words = tables_of(tokenizer), Words()
        for batch in batches:
            key, cols, held, at = batch.column(0), [[], [], []], 0, 0
            for raw in column(batch, "raw"):
                for c, x in zip(cols, one((raw or b"").decode("utf-8", "replace"), tables, words)):
                    c.append(x)
                held += 1 if digests else 1 + len(raw or b"") // 1000
                if held >= 10_000:
                    yield _batch(key, at, cols, kinds)
                    at, cols, held = at + len(cols[0]), [[], [], []], 0
            if cols[0]:
                yield _batch(key, at, cols, kinds)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, OUT.format(kind) + names)


def _batch(key, at: int, cols: list[list], kinds: list) -> pa.RecordBatch:
    names = ["ids_sha256", "decoded_sha256"] if kinds[0] == pa.string() else ["ids", "decoded"]
    return pa.RecordBatch.from_arrays(
        [key.slice(at, len(cols[0])), *(pa.array(c, k) for c, k in zip(cols, [pa.int64(), *kinds]))],
        names=["doc_id", "n_tokens", *names])


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, decoded string)`` from ``(doc_id, ids array<int>)``. Null ids give null,
    ids outside the vocabulary nothing."""
    def run(batches):
        tables = tables_of(tokenizer)
        for batch in batches:
            out = []
            for ids in column(batch, "ids"):
                d = Decoder(tables)
                out.append(None if ids is None else d.feed(ids) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())],
                                             names=["doc_id", "decoded"])
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
