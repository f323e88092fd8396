"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The pretokenised text is a sequence of words; within a word, merges apply by rank. A token
is stable once enough of the word behind it is known. How much is enough follows from the
merge list alone (``lookahead``): when a word is cut at some point, stage by stage of the
merge list the tokens that may differ reach further left only if the merge's left part ends
where the difference starts, so the reach is the longest such chain of merges of rising rank.
The transducer reads a word through a window, emits what lies further than the lookahead
from the window's end, and starts anew behind the last token it emitted, which no merge
crosses. That lookahead is the greatest of all words; what a window's own letters leave open is
mostly less (``Transducer.reach``), so it looks from 64 letters on and emits what is stable.
Tokens held are bounded, whatever the length of a word.

Every word takes this way; what came out for a short word is remembered, within a bound.

Decoding feeds a document's ids, a bounded group at a time, to an incremental UTF-8 machine
that gives out text as soon as code points are whole. The digests of ids and text take up
what comes out, so of a document only its text is held whole.

Defined results: null text is empty; the empty text has no tokens, and its digest is that of
the empty string; the strings of added tokens inside a text become those tokens, as the
tokenizers library has it; repeated rows are encoded one by one; ids are null where they are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import documents, mapped, text_or_empty

#: Words and chunks kept per worker, twice: what was met since a memo was last full, and what before.
MEMO = 200_000
#: Letters of a text, or ids, that are held as tokens at a time; letters of a word at the first look.
GROUP, FIRST_LOOK = 1 << 14, 64

#: Unicode white space. (str.split() also breaks at U+001C to U+001F, which are not.)
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: itself where printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols behind a token that decide about it, from the merge list.

    ``reach[x]``: how far left of the cut the difference may have come when it starts just
    before a token x. A merge (a, b) carries it over a when b starts there, that is, when b
    begins with some x already reached at lower rank, or with the cut itself.
    """
    reach: dict[str, int] = {}
    far = 1
    for a, b in merges:
        before = max((reach.get(b[:i], 0) for i in range(1, len(b) + 1)), default=0)
        here = before + len(a)
        if here > reach.get(a, 0):
            reach[a] = here
            far = max(far, here)
    return far


class Transducer:
    """Encoder and decoder of one tokenizers file with word ends (BPE, lower case)."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.wholes = [a + b for a, b in pairs]
        #: The rank of a pair: by its left part, then by its right part.
        self.ranks: dict[str, dict[str, int]] = {x: {} for p in (self.vocab, *pairs, self.wholes) for x in p}
        for rank, (left, right) in enumerate(pairs):
            self.ranks[left][right] = rank
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))
        # The word end counts as part of its letter, here as everywhere else.
        bare = [tuple(x.removesuffix(self.end) if self.end else x for x in p) for p in pairs]
        self.ahead = lookahead(bare) + 1
        self.longest = max(map(len, self.vocab))
        self.rights: dict[str, list[tuple[int, str]]] = {}
        for rank, (left, right) in enumerate(bare):
            self.rights.setdefault(left, []).append((rank, right))
        self.window = 2 * (self.ahead + self.longest)
        self.spelled = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.joined = {i: (" " + t).encode() for i, t in self.spelled.items()}
        self.decimal = {i: str(i) for i in self.spelled}
        self.memo, self.machine = memo, Decoder(self, plain=False)
        self.words, self.chunks = _Memo(self, self.word), _Memo(self, self._chunk)

    # -- encoding -----------------------------------------------------------------------

    def _merge(self, symbols: list[str]) -> list[str]:
        """All merges by rank within one window; of equal ranks the leftmost first."""
        ranks, wholes, none = self.ranks, self.wholes, len(self.wholes)
        rank = [ranks[a].get(b, none) for a, b in zip(symbols, symbols[1:])]
        rank.append(none)  # nothing stands behind the last
        while (best := min(rank)) < none:
            at = rank.index(best)
            del symbols[at], rank[at]
            symbols[at] = whole = wholes[best]
            if at:
                rank[at - 1] = ranks[symbols[at - 1]].get(whole, none)
            if at + 1 < len(symbols):
                rank[at] = ranks[whole].get(symbols[at + 1], none)
        return symbols

    def reach(self, text: str) -> int:
        """Letters at the end of a word's beginning about whose tokens the rest of the word decides.

        Where the difference may start, at which rank at the least: at the end at any rank; and
        before a merge's left part if it may start behind that at a lower rank, and the
        merge's right part agrees with the text from there on, as far as it is known.
        """
        least = {len(text): 0}
        for at in range(len(text), 0, -1):
            if at not in least:
                continue
            rest = text[at:]
            for n in range(1, min(self.longest, at) + 1):
                for rank, right in self.rights.get(text[at - n : at], ()):
                    if rank >= least[at] and (right.startswith(rest) or rest.startswith(right)):
                        least[at - n] = min(rank, least.get(at - n, rank))
                        break  # the others have greater ranks
        return len(text) - min(least)

    def stream_word(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word from its letters, each as soon as it is stable."""
        source, full = iter(symbols), FIRST_LOOK
        held = list(islice(source, full + 1))
        while len(held) > full:  # the letter behind those looked at may be the word's last
            seen = held[:full]
            stable, keep = 0, full - min(self.ahead, self.reach("".join(seen)) + 1)
            for token in self._merge(seen):
                if stable + len(token) > keep:
                    break
                stable += len(token)
                yield token
            del held[:stable]
            # Where little comes out, the next look is later, up to the lookahead of all words.
            full = min(self.window, max(FIRST_LOOK, 2 * (len(held) - 1)))
            held.extend(islice(source, full + 1 - len(held)))
        if held:
            held[-1] += self.end
        yield from self._merge(held)

    def word(self, piece: str) -> tuple[int, ...]:
        """Every word goes through the window; one shorter than it comes out at its end."""
        return tuple(map(self.vocab.__getitem__, self.stream_word(map(self.letters.__getitem__, piece.encode()))))

    def words_of(self, chunk: str) -> Iterable[str]:
        """Words of a run without white space, normalised."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        # One by one where a letter's lower case depends on its neighbours.
        chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        if chunk.isalpha():
            return (chunk,)  # letters alone are one word
        if len(chunk) > GROUP:
            return (found[0] for found in self.pieces.finditer(chunk))
        return self.pieces.findall(chunk)

    def split(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else [text]):
            if k % 2:
                ids.append(self.added[part])
            else:
                for c in self.split(part):
                    for w in self.words_of(c):
                        ids.extend(self.word(w))
        return ids

    def stream(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        """The ids of a text, and the ids in decimal, in groups of bounded size."""
        at = 0
        for special in self.special.finditer(text) if "<|" in text else ():
            yield from self._plain(text, at, special.start())
            own = self.added[special[0]]
            yield (own,), str(own)
            at = special.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[tuple[tuple[int, ...], str]]:
        while at < end:
            to = at + GROUP
            if to < end:
                space = _SPACES.search(text, to, end)
                to = space.end() if space else end
            else:
                to = end
            found, after = self.split(text[at:to]), 0
            # A chunk of more than a group has its place in a piece of more than a group only.
            for k, chunk in enumerate(found) if to - at > GROUP else ():
                if len(chunk) <= GROUP:
                    continue
                yield self._shown(found[after:k])
                after = k + 1
                for word in self.words_of(chunk):
                    tokens = map(self.vocab.__getitem__, self.stream_word(map(self.letters.__getitem__, word.encode())))
                    while some := tuple(islice(tokens, GROUP)):
                        yield some, " ".join(map(self.decimal.__getitem__, some))
            yield self._shown(found[after:] if after else found)
            at = to

    def encode_shown(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, joined by blanks, and the text that decoding them gives."""
        shown, decoded, machine = [], [], self.machine.restart()
        n = 0
        for ids, decimal in self.stream(text):
            if ids:
                n += len(ids)
                shown.append(decimal)
                decoded.append(machine.feed_all(ids))
        return n, " ".join(shown), "".join(decoded) + machine.close()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of what ``encode_shown`` gives, of which only a group is held."""
        shown, decoded, machine = hashlib.sha256(), hashlib.sha256(), self.machine.restart()
        n = 0
        for ids, decimal in self.stream(text):
            if ids:
                shown.update((" " + decimal if n else decimal).encode())
                decoded.update(machine.feed_all(ids).encode())
                n += len(ids)
        decoded.update(machine.close().encode())
        return n, shown.hexdigest(), decoded.hexdigest()

    def _shown(self, chunks: list[str]) -> tuple[tuple[int, ...], str]:
        """The ids of short chunks, and the ids in decimal."""
        ids = tuple(chain.from_iterable(map(self.chunks.__getitem__, chunks)))
        return ids, " ".join(map(self.decimal.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        found = [self.words[w] for w in self.words_of(chunk)]
        return found[0] if len(found) == 1 else tuple(chain.from_iterable(found))

    # -- decoding -----------------------------------------------------------------------

    def decoder(self, plain: bool = False) -> Decoder:
        """``plain``: text again, a blank at each word end. Else as the library decodes a file
        that names no decoder: the tokens' spellings, joined by blanks."""
        return Decoder(self, plain)

    def decode(self, ids: Iterable[int], plain: bool = False) -> str:
        d = self.decoder(plain)
        return d.feed_all(ids) + d.close()


class _Memo(dict):
    """Text -> ids. Bounded: when full, it starts anew, and what it held is kept as the older half
    until it is full again. What is met there comes back, so frequent texts stay."""

    def __init__(self, owner: Transducer, make: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.owner, self.make, self.older = owner, make, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        got = self.older.get(text)
        if got is None:
            got = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.owner.memo:
                self.older = dict(self)
                self.clear()
            self[text] = got
        return got


class Decoder:
    """Ids to text, one at a time: a machine whose state is an unfinished code point."""

    def __init__(self, owner: Transducer, plain: bool) -> None:
        self.spelled, self.joined, self.end, self.plain = owner.spelled, owner.joined, owner.end, plain
        self.special = set(owner.added.values())
        self.bytes_of = {c: b for b, c in owner.letters.items()} if plain else {}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def restart(self) -> Decoder:
        self.utf8.reset()
        self.first = True
        return self

    def _bytes(self, token: int) -> bytes:
        if not self.plain:
            return self.joined[token]
        shown = self.spelled[token]
        if token in self.special:
            return shown.encode()
        ends = bool(self.end) and shown.endswith(self.end)
        body = shown.removesuffix(self.end) if ends else shown
        return bytes(self.bytes_of[c] for c in body) + b" " * ends

    def feed(self, token: int) -> str:
        return self.feed_all((token,))

    def feed_all(self, tokens: Iterable[int]) -> str:
        """The text that these tokens complete."""
        out = b"".join(map(self._bytes if self.plain else self.joined.__getitem__, tokens))
        if self.first and not self.plain and out:
            out, self.first = out[1:], False  # no blank before the first
        return self.utf8.decode(out)

    def close(self) -> str:
        return self.utf8.decode(b"", final=True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process."""
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (array of int) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            ids = pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return mapped(rows, run, f"id {kind}, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of the ids and of the decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            rows = [t.digests(x.as_py()) for x in b.column(1)]
            n, a, d = zip(*rows) if rows else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return mapped(rows, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
