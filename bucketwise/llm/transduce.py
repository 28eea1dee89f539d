"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Encoding goes from left to right over a pre-token. The tokens of every prefix are unique: the last one is
the vocabulary token that ends here and does not merge with the last token of the prefix before it. So one
token a byte is all the state there is. A token is emitted once no further text can change it, which is when as
many bytes have been read behind it as the merge list's sufficient lookahead says; what has been emitted
is forgotten. Memory is constant however long a text or a pre-token is.

The lookahead. Let two texts share a prefix, and apply the merges in the order of their ranks to both. Left of a
border both have the same tokens; it starts at the end of the prefix. A merge (u, v) moves it to the left, by the
length of u, only if v begins at the border in one of the texts. If the border was last moved by (u', v'), then v
begins with u', or with u' v' or another token made from u' later: u' stands on the left spine of v, and what
consumes it there has no lower rank than (u', v'). The largest sum of lengths along such a chain of rising
ranks bounds how far what follows a prefix can reach back into it.

Decoding joins the bytes of the tokens and runs them through a state machine for UTF-8 that keeps at
most three bytes of an unfinished character; a broken sequence becomes one replacement character.

Defined cases: a null text encodes like an empty one, to one block without ids; strings that are tokens of
their own get their id wherever they stand; repeated rows and null ids are encoded each for itself; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from bucketwise.llm.pretokens import TokenCache, gather, pretokens
from bucketwise.llm.ragged import CHUNK_BYTES, chunks, text_bytes
from bucketwise.llm.vocabulary import read_merges

NEVER = 1 << 40
LONG = 512      # bytes of a pre-token above which it is streamed instead of looked up
GUARD = 16      # bytes that decide where a pre-token ends: a special string, or an apostrophe and its letters
REMEMBERED = 1 << 17


class Transducer:
    """Merge list of one tokenizer file with what follows from it; picklable."""

    def __init__(self, path: str):
        of_byte, table, added = read_merges(path)
        if len(added) > 1:
            raise ValueError("one added token at most is handled")
        self.special, self.special_id = next(((s.encode(), i) for s, i in added.items()), (b"", -1))
        self.of_byte, self.table = of_byte, table
        self._derive()
        size = np.zeros(max(int(table.max(initial=0)), int(of_byte.max()), self.special_id) + 1, np.int64)
        texts = {int(t): bytes([b]) for b, t in enumerate(of_byte)}
        for left, right, new in table.tolist():
            texts[new] = texts[left] + texts[right]
        if self.special:
            texts[self.special_id] = self.special
        for token, text in texts.items():
            size[token] = len(text)
        self.size = size
        self.begin = np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(size))), np.uint8)
        self.lookahead = self._sufficient_lookahead()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("special", "special_id", "of_byte", "table", "size", "begin", "bytes", "lookahead")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._derive()

    def _derive(self) -> None:
        self.rank, self.parts, self.made = {}, {}, {int(t): -1 for t in self.of_byte}
        for rank, (left, right, new) in enumerate(self.table.tolist()):
            if new in self.made or left not in self.made or right not in self.made:
                raise ValueError("every merge must make a new token from tokens made before")
            self.rank[left << 32 | right] = rank
            self.parts[new] = left, right
            self.made[new] = rank
        self.child, self.ending, self.known = None, {}, {}
        self.cache = TokenCache(lambda pieces: [Stream(self).push(p, final=True) for p in pieces])

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge (0 left, 1 right) while ``token`` is made, and the rank that consumes each."""
        out, end = [], NEVER
        while True:
            out.append((token, end))
            if token not in self.parts:
                return out
            end, token = self.made[token], self.parts[token][side]

    def merges(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge of lower rank than ``before`` goes across the border between two tokens."""
        for x, x_end in self.spine(left, 1):
            for y, y_end in self.spine(right, 0):
                rank = self.rank.get(x << 32 | y)
                if rank is not None and rank < before and rank < x_end and rank <= y_end:  # runs merge from the left
                    return True
        return False

    def _sufficient_lookahead(self) -> int:
        ranks: dict[int, list[int]] = {}
        reaches: dict[int, list[int]] = {}
        most = 0
        for rank, (left, right, _) in enumerate(self.table.tolist()):
            before = 0
            for token, end in self.spine(right, 0):
                k = bisect_right(ranks.get(token, ()), end)
                if k:
                    before = max(before, reaches[token][k - 1])
            reach = int(self.size[left]) + before
            own = reaches.setdefault(left, [])
            ranks.setdefault(left, []).append(rank)
            own.append(max(reach, own[-1]) if own else reach)
            most = max(most, reach)
        return most

    def _grow(self) -> None:
        """The tokens that can come out, as a trie over their bytes from the last to the first."""
        self.child, nodes = {}, 1
        for token in self.made:
            if token in self.parts and self.merges(*self.parts[token], before=self.made[token]):
                continue  # its own bytes never become it
            node = 0
            for byte in reversed(self.bytes[self.begin[token]:self.begin[token] + self.size[token]].tolist()):
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = nodes
                    nodes += 1
            self.ending[node] = token

    def borders(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart; remembered for a bounded number of pairs."""
        key = left << 32 | right
        apart = self.known.get(key)
        if apart is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            apart = self.known[key] = not self.merges(left, right)
        return apart

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of closed pre-tokens one after the other, and how many each has."""
        counts = np.ones(len(starts), np.int64)
        short = ~special & (ends - starts <= LONG)
        begin, size = self.cache(data, starts[short], ends[short])
        counts[short] = size
        long = np.flatnonzero(~special & ~short)
        streamed = [np.array(Stream(self).push(data[a:b].tobytes(), final=True), np.uint32)
                    for a, b in zip(starts[long], ends[long], strict=True)]
        counts[long] = list(map(len, streamed))
        kind = np.repeat(np.where(special, 2, np.where(short, 0, 1)), counts)
        ids = np.empty(len(kind), np.uint32)
        ids[kind == 0] = gather(self.cache.ids, begin, size)
        if len(long):
            ids[kind == 1] = np.concatenate(streamed)
        ids[kind == 2] = max(self.special_id, 0)
        return ids, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and the offset of each text in them."""
        starts, ends, special = pretokens(data, offsets, self.special)
        ids, counts = self.pieces(data, starts, ends, special)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.begin[ids], self.size[ids])


class Stream:
    """Tokens of one pre-token whose bytes come in any portions."""

    def __init__(self, rules: Transducer):
        self.rules = rules
        if rules.child is None:
            rules._grow()
        self.window = b""         # bytes whose tokens have not been emitted
        self.last: list[int] = []  # last token of each prefix of the window

    def push(self, data: bytes, final: bool) -> list[int]:
        """The tokens that are stable now."""
        out: list[int] = []
        step = max(4 * self.rules.lookahead, 4096)
        for at in range(0, len(data), step):
            self._read(data[at:at + step])
            if at + step < len(data):
                out += self._stable()
        return out + (self._tokens(len(self.window)) if final else self._stable())

    def _read(self, data: bytes) -> None:
        child, ending, borders, last = self.rules.child, self.rules.ending, self.rules.borders, self.last
        begin = len(self.window)
        self.window += data
        window = self.window
        for i in range(begin, len(window)):
            node, j = 0, i
            while True:
                node = child[node << 8 | window[j]]
                token = ending.get(node)
                if token is not None and (j == 0 or borders(last[j - 1], token)):
                    last.append(token)
                    break
                j -= 1

    def _tokens(self, to: int) -> list[int]:
        out, size = [], self.rules.size
        while to:
            token = self.last[to - 1]
            out.append(token)
            to -= int(size[token])
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens that end a lookahead before the end of what has been read; they leave the window."""
        limit, size, end = len(self.window) - self.rules.lookahead, self.rules.size, len(self.window)
        while end > max(limit, 0):
            end -= int(size[self.last[end - 1]])
        out = self._tokens(end)
        # Prefixes that end inside what has been emitted are prefixes no more; those behind it have the same last tokens.
        self.window, self.last = self.window[end:], self.last[end:]
        return out


class TextEncoder:
    """Ids of one text that comes in blocks (whole characters each)."""

    def __init__(self, rules: Transducer):
        self.rules, self.tail = rules, b""
        self.open: Stream | None = None  # of a pre-token that began before the tail

    def feed(self, block: bytes, final: bool) -> np.ndarray:
        raw = self.tail + block
        data, n = np.frombuffer(raw, np.uint8), len(raw)
        starts, ends, special = pretokens(data, np.array([0, n]), self.rules.special)
        closed = len(starts) if final else int(np.searchsorted(ends, n - GUARD, side="right"))
        out, first = [], 0
        if self.open and closed:
            out.append(np.array(self.open.push(raw[:ends[0]], final=True), np.uint32))
            self.open, first = None, 1
        out.append(self.rules.pieces(data, starts[first:closed], ends[first:closed], special[first:closed])[0])
        at = int(starts[closed]) if closed < len(starts) else n
        if not final and n - at > LONG:
            cut = int(ends[closed]) - 2 * GUARD  # enough stays to see that the pre-token goes on
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            self.open = self.open or Stream(self.rules)
            out.append(np.array(self.open.push(raw[at:cut], final=False), np.uint32))
            at = cut
        self.tail = raw[at:]
        if final and self.open:  # nothing followed the last cut
            out.append(np.array(self.open.push(b"", final=True), np.uint32))
        return np.concatenate(out)


class TextDecoder:
    """Valid UTF-8 from bytes that come in any portions; a broken sequence is one U+FFFD, as lossy decoders write it."""

    REPLACEMENT = "�".encode()

    def __init__(self):
        self.rest = b""  # begin of a character

    @staticmethod
    def expects(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a first byte, and the range of the first of them; (-1, ..) if none can begin with it."""
        if lead < 0x80:
            return 0, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return -1, 0, 0

    def feed(self, data: bytes, final: bool) -> bytes:
        raw = self.rest + data
        keep = 0  # bytes at the end that may go on
        for k in range(1, min(3, len(raw)) + 1):
            more, low, high = self.expects(raw[-k])
            if raw[-k] & 0xC0 != 0x80:
                if more >= k and (k == 1 or low <= raw[1 - k] <= high):
                    keep = k
                break
        if final:
            keep = 0
        whole, self.rest = raw[:len(raw) - keep], raw[len(raw) - keep:]
        return whole if is_valid(np.frombuffer(whole, np.uint8)) else self._run(whole)

    def _run(self, raw: bytes) -> bytes:
        out, held, more, low, high = bytearray(), bytearray(), 0, 0, 0
        for byte in raw:
            if more:
                if low <= byte <= high:
                    held.append(byte)
                    more, low, high = more - 1, 0x80, 0xBF
                    if not more:
                        out += held
                    continue
                out += self.REPLACEMENT
            more, low, high = self.expects(byte)
            if more > 0:
                held = bytearray([byte])
            else:
                out += bytes([byte]) if more == 0 else self.REPLACEMENT
                more = 0
        return bytes(out + self.REPLACEMENT if more else out)


_MORE = np.array([max(TextDecoder.expects(b)[0], 0) for b in range(256)], np.uint8)


def is_valid(data: np.ndarray, offsets: np.ndarray | None = None) -> bool:
    """The state machine for all bytes at once: whether every character is whole and ends before the next text begins."""
    n = len(data)
    follows = (data & 0xC0) == 0x80
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    more = _MORE[first]
    if (more == 0).any() or (len(lead) and int((lead + more).max()) >= n):
        return False
    due = np.zeros(n + 4, bool)
    for k in (1, 2, 3):
        due[lead[more >= k] + k] = True
    if not np.array_equal(due[:n], follows):
        return False
    second = data[lead + 1] if len(lead) else first
    bad = ((first == 0xE0) & (second < 0xA0)) | ((first == 0xED) & (second > 0x9F))
    bad |= ((first == 0xF0) & (second < 0x90)) | ((first == 0xF4) & (second > 0x8F))
    if bad.any():
        return False
    return offsets is None or not follows[offsets[offsets < n]].any()


def _blocks(text: memoryview, size: int) -> Iterator[tuple[bytes, bool]]:
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        while to < len(text) and text[to] & 0xC0 == 0x80:
            to -= 1
        yield bytes(text[at:to]), to == len(text)
        at = to


def _batch(ids: pa.Array, first: np.ndarray, tokens: np.ndarray, at: np.ndarray, name: str) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids, pa.array(first), lists], [name, "first", "ids"])


def _encoded(rules: Transducer, batches: Iterator[pa.RecordBatch], id_column: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=size):
            data, offsets = text_bytes(part.column("text"))
            owner = part.column(id_column)
            if len(data) <= size:
                ids, at = rules.encode(data, offsets)
                yield _batch(owner, np.ones(part.num_rows, bool), ids, at, id_column)
                continue
            encoder, first = TextEncoder(rules), True
            for block, final in _blocks(memoryview(data), size):
                ids = encoder.feed(block, final)
                yield _batch(owner, np.array([first]), ids, np.array([0, len(ids)]), id_column)
                first = False


def _shared(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(Transducer(path or public_tokenizers.path("byte_bpe_50k.json")))


def token_blocks(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every text in blocks: a text is one row, or several in order if it is long; ``first`` marks where one begins."""
    shared, size, kind = _shared(docs, path), CHUNK_BYTES, dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(shared.value, batches, id_column, size)

    return docs.select(id_column, docs[text_column].alias("text")).mapInArrow(
        run, f"`{id_column}` {kind}, first boolean, ids array<int>")


def decoded_blocks(blocks: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """The texts of ``token_blocks`` in blocks, with the number of their ids; the order of the rows is used as it is."""
    shared, kind = _shared(blocks, path), dict(blocks.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, decoder, owner = shared.value, TextDecoder(), None

        def row(key: pa.Scalar, first: bool, text: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([first]), pa.array([text.decode()])],
                                              [id_column, "first", "text"])

        for batch in batches:
            for i in range(batch.num_rows):
                first = batch.column("first")[i].as_py()
                if first and owner is not None:
                    yield row(owner, False, decoder.feed(b"", final=True))
                    decoder = TextDecoder()
                owner = batch.column(id_column)[i]
                ids = batch.column("ids")[i].values.to_numpy()
                yield row(owner, first, decoder.feed(rules.decode(ids).tobytes(), final=False))
        if owner is not None:
            yield row(owner, False, decoder.feed(b"", final=True))

    return blocks.mapInArrow(run, f"`{id_column}` {kind}, first boolean, text string")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(rules: Transducer, batches: Iterator[pa.RecordBatch], id_column: str) -> Iterator[pa.RecordBatch]:
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
    open_text, kind = None, None  # id, ids, digest of ids, decoder, digest of text

    def close() -> list:
        owner, n, hashed, decoder, text = open_text
        text.update(decoder.feed(b"", final=True))
        return [owner, n, hashed.hexdigest(), text.hexdigest()]

    for batch in batches:
        kind, lists = batch.schema.field(id_column).type, batch.column("ids")
        at = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[at[0]:at[-1]]
        at = at - at[0]
        raw = rules.decode(ids)
        ends = np.concatenate([[0], np.cumsum(rules.size[ids])])[at]
        valid = is_valid(raw, ends)
        ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
        out: list[list] = []
        for i, (owner, first) in enumerate(zip(batch.column(id_column).to_pylist(), batch.column("first").to_pylist(), strict=True)):
            if first:
                if open_text:
                    out.append(close())
                open_text = [owner, 0, hashlib.sha256(), TextDecoder(), hashlib.sha256()]
            open_text[1] += int(at[i + 1] - at[i])
            open_text[2].update(ids[4 * at[i]:4 * at[i + 1]])
            bits = raw[ends[i]:ends[i + 1]]
            open_text[4].update(bits if valid and not open_text[3].rest else open_text[3].feed(bytes(bits), final=False))
        yield _digest_rows(out, kind, names)
    if open_text:
        yield _digest_rows([close()], kind, names)


def block_digests(blocks: DataFrame, path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """Per document of ``token_blocks``: number of ids, digest of the ids, and of the text decoded from them."""
    shared, kind = _shared(blocks, path), dict(blocks.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digested(shared.value, batches, id_column)

    return blocks.mapInArrow(run, f"`{id_column}` {kind}, {DIGESTS}")


def document_digests(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``block_digests`` of ``token_blocks`` in one worker, so that no ids go between processes."""
    shared, size, kind = _shared(docs, path), CHUNK_BYTES, dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _digested(shared.value, _encoded(shared.value, batches, id_column, size), id_column)

    return docs.select(id_column, docs[text_column].alias("text")).mapInArrow(run, f"`{id_column}` {kind}, {DIGESTS}")


def _digest_rows(rows: list[list], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string()),
                                                                      strict=True)], names)
