"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text gets the leading space and the ``▁`` of the model's own convention and is cut where no piece
can cross: before each run of ``▁``. Over the pieces that fit a chunk's characters the forward
filter sums path weights; the backward pass then samples one piece after another from the end,
each in proportion to the weight of all paths that reach it. That draws every segmentation with its
probability, up to the rounding of shares to single precision and of draws to 24 bits. The random numbers are a hash of the seed, the row key and the place in
the text, so a row is cut the same way in every run and on every partition.

A BPE vocabulary gives ranks instead of probabilities; rank r weighs (r + 1) ** -``alpha``, after the law
of word frequencies. A larger alpha comes closer to the single best segmentation. Characters without a piece, the line feed
and a literal ``▁`` are spelled as byte pieces, so every text comes back exactly.

Chunks of half a million characters are filtered together: those that the task has no table of yet as columns of arrays, all
ends of pieces of one length at a time as long as a piece ends like that, then one place of all chunks at a time. A task keeps its tables up to a fixed size. The vocabulary is read
on the driver from ``model_file`` and broadcast: it is a file of fixed size (0.5 MB).

Defined cases: null and empty texts have no pieces and decode to the empty text; a null key is a key of
its own; repeated rows give equal pieces; empty tables give empty results. Texts of any length are encoded
whole, in sections that end where a chunk does. Of the input's columns those stay that the caller names, unless a result has the name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MAX_PIECE = 16
TABLE_BITS = 18
ENDS_BITS = 20
GOLDEN = 0x9E3779B97F4A7C15
CHAR_BASE = 0xD6E8FEB86659FD93
BYTES = np.uint64(0x0101010101010101)
#: Characters that are encoded together.
GROUP = 1 << 19
#: Private characters that stand for single bytes within a chunk.
BYTE_BASE = 0xF0000
#: A state below this is scaled up. In four places a weight of at least (vocabulary size) ** -MAX_ALPHA each
#: takes it nowhere near underflow, and within a piece's reach ratios stay finite.
SMALL = 1e-30
MAX_ALPHA = 4.0
#: Places of chunks whose tables a task keeps between groups of texts, at 128 bytes each.
KEPT_PLACES = 400_000
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load_vocabulary(model_file: str = MODEL_FILE) -> dict:
    """pieces: text to id, byte_ids: id of each byte, size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, bytes_ = {}, [0] * 256
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(name[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            # A piece that crosses a chunk's border, or is no part of any lattice, is never drawn.
            if SPACE not in name.lstrip(SPACE) and len(name) <= MAX_PIECE and name != "":
                pieces[name] = i
    return {"pieces": pieces, "bytes": bytes_, "size": model.get_piece_size()}


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * np.uint64(GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)


class Lattice:
    """Piece weights, found by rolling hashes of the characters that they end at."""

    def __init__(self, vocabulary: dict, alpha: float) -> None:
        if not 0 <= alpha <= MAX_ALPHA:
            raise ValueError(f"alpha must be between 0 and {MAX_ALPHA}")
        ids = dict(vocabulary["pieces"])
        ranks = {i: r for r, i in enumerate(sorted(ids.values()))}
        self.weight = {name: float((ranks[i] + 1.0) ** -alpha) for name, i in ids.items()}
        for b, i in enumerate(vocabulary["bytes"]):
            ids[chr(BYTE_BASE + b)] = i
            self.weight[chr(BYTE_BASE + b)] = float((len(ranks) + 1.0) ** -alpha)
        names = list(ids)
        self.known = np.zeros(0x110000, dtype=bool)
        self.known[[ord(name) for name in names if len(name) == 1]] = True
        self.known[BYTE_BASE:BYTE_BASE + 256] = True
        # The entry after the last stands for "no piece".
        self.ids = np.array([ids[name] for name in names] + [0], dtype=np.int32)
        self.weights = np.array([self.weight[name] for name in names] + [0.0])
        keys, entries = [0] * (1 << TABLE_BITS), [len(names)] * (1 << TABLE_BITS)
        powers = [pow(CHAR_BASE, k + 1, 1 << 64) for k in range(MAX_PIECE)]
        for i, name in enumerate(names):
            h = sum((ord(c) + 1) * power for c, power in zip(reversed(name), powers)) % (1 << 64)
            slot = (h * GOLDEN % (1 << 64)) >> (64 - TABLE_BITS)
            while keys[slot]:
                if keys[slot] == h:
                    raise ValueError("two pieces have the same hash")
                slot = (slot + 1) % len(keys)
            keys[slot], entries[slot] = h, i
        # Marks the hashes of what pieces end in: a string that has none is no end of a longer piece either.
        self.ends = np.zeros(1 << ENDS_BITS, dtype=bool)
        for k in range(1, MAX_PIECE):
            some = _codes(list({name[-k:] for name in names if len(name) > k})).reshape(-1, k)
            hashes = np.zeros(len(some), dtype=np.uint64)
            for place in range(k):
                hashes = hashes + _char_hash(some[:, k - 1 - place], place)
            self.ends[_slots(hashes, ENDS_BITS)] = True
        self.keys, self.entries = np.array(keys, dtype=np.uint64), np.array(entries, dtype=np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash."""
        slots = _slots(hashes, TABLE_BITS)
        there = self.keys[slots]
        out = np.where(there == hashes, self.entries[slots], len(self.weights) - 1)
        todo = np.flatnonzero((there != hashes) & (there != 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) % len(self.keys)
            there = self.keys[slots[todo]]
            hit = there == hashes[todo]
            out[todo[hit]] = self.entries[slots[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def spelled(self, chunks: list[str]) -> list[str]:
        """The chunks with characters that have no piece spelled as bytes."""
        flat = _codes(chunks)
        odd = np.flatnonzero(~self.known[flat])
        if len(odd) == 0:
            return chunks
        ends = np.cumsum([len(c) for c in chunks])
        out = list(chunks)
        as_bytes = {c: "".join(chr(BYTE_BASE + b) for b in chr(c).encode()) for c in np.unique(flat[odd]).tolist()}
        for i in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
            out[i] = chunks[i].translate(as_bytes)
        return out


def _codes(chunks: list[str]) -> np.ndarray:
    return np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _char_hash(codes: np.ndarray, place: int) -> np.ndarray:
    """What a character adds to the hash of a string whose last character is at place 0."""
    power = np.uint64(pow(CHAR_BASE, place + 1, 1 << 64))
    return (codes.astype(np.uint64) + np.uint64(1)) * power


class Filtered:
    """Forward filtering of distinct chunks. Row ``start + p - 1`` of a chunk holds, for the pieces of
    1 to MAX_PIECE characters that end at place p, their cumulative shares and ids."""

    def __init__(self, lattice: Lattice, chunks: list[str]) -> None:
        chunks = lattice.spelled(chunks)
        self.lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = _codes(chunks)
        total = len(codes)
        offset = np.arange(total) - np.repeat(self.starts, self.lengths)
        entries = np.full((total, MAX_PIECE), len(lattice.weights) - 1, dtype=np.int32)
        rows, hashes = np.arange(total), np.zeros(total, dtype=np.uint64)
        for k in range(MAX_PIECE):
            inside = offset[rows] >= k
            rows, hashes = rows[inside], hashes[inside]
            if len(rows) == 0:
                break
            hashes = hashes + _char_hash(codes[rows - k], k)
            entries[rows, k] = lattice.find(hashes)
            longer = lattice.ends[_slots(hashes, ENDS_BITS)]
            rows, hashes = rows[longer], hashes[longer]
        self.entries, self.ids = entries, lattice.ids
        self.shares = np.ones((total, MAX_PIECE), dtype=np.float32)
        # State 0 of every chunk has weight 1; a piece of k characters comes from k states before.
        # A chunk's last states stand side by side, the newest at ``head``, and move back to the end when the front is reached.
        states = np.zeros((len(chunks), 4 * MAX_PIECE))
        head = states.shape[1] - MAX_PIECE
        states[:, head] = 1.0
        longest_first = np.argsort(-self.lengths, kind="stable")
        counts = np.searchsorted(-self.lengths[longest_first], -np.arange(self.lengths.max(initial=0)), side="left")
        row = self.starts[longest_first]
        for p, live in enumerate(counts.tolist()):
            row, width = row[:live], min(p + 1, MAX_PIECE)
            sums = lattice.weights.take(entries[row, :width])
            sums *= states[:live, head:head + width]
            np.cumsum(sums, axis=1, out=sums)
            last = sums[:, -1]
            if head == 0:
                head = states.shape[1] - MAX_PIECE
                states[:live, head:] = states[:live, :MAX_PIECE]
            head -= 1
            states[:live, head] = last
            self.shares[row, :width] = sums / last[:, None]
            # Only ratios within one piece's reach matter: where the newest state is small, the states
            # that a piece can still start from are divided by it.
            if p % 4 == 3 and len(low := np.flatnonzero(last < SMALL)):
                states[low, head:head + MAX_PIECE] /= last[low, None]
            row = row + 1


class Tables:
    """Filtered chunks that are kept from one group of texts to the next, up to ``KEPT_PLACES``.

    Frequent words come again in every group; a chunk's table depends on the chunk alone."""

    def __init__(self, lattice: Lattice, most: int = KEPT_PLACES) -> None:
        self.lattice, self.most, self.ids = lattice, most, lattice.ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.used, self.size = 0, 0
        # By chunk: the first place, the places, and the characters as they stand in the text.
        self.starts, self.lengths, self.sizes = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.entries = np.zeros((0, MAX_PIECE), dtype=np.int32)
        self.shares = np.zeros((0, MAX_PIECE), dtype=np.float32)

    def _room(self, rows: int) -> None:
        if self.used + rows > len(self.entries):
            size = max(2 * len(self.entries), self.used + rows)
            for name in ("entries", "shares"):
                old = getattr(self, name)
                new = np.empty((size, MAX_PIECE), dtype=old.dtype)
                new[:self.used] = old[:self.used]
                setattr(self, name, new)

    def places_of(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk's table; tables that are missing are made."""
        if self.used > self.most:
            self.clear()
        known = self.known
        new = list(dict.fromkeys([c for c in chunks if c not in known]))
        if new:
            made = Filtered(self.lattice, new)
            rows = len(made.entries)
            self._room(rows)
            self.entries[self.used:self.used + rows], self.shares[self.used:self.used + rows] = made.entries, made.shares
            self.starts = np.concatenate([self.starts, made.starts + self.used])
            self.lengths = np.concatenate([self.lengths, made.lengths])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.used += rows
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))


def sample(table: Filtered | Tables, which: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of many chunks at once: (ids in order, number of ids per chunk).

    ``which`` names the distinct chunk, ``keys`` and ``places`` the row key and the place in the text."""
    first = table.starts[which]
    at = first + table.lengths[which]
    live = np.arange(len(which))
    ids, owners, counts = [], [], np.zeros(len(which), dtype=np.int64)
    while len(live):
        row = at[live] - 1
        draw = _mix64(keys[live] + (places[live] + (row - first[live])).astype(np.uint64) * np.uint64(GOLDEN))
        u = ((draw >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24)
        # The flags of a row are 16 bytes: added up as two numbers, and those by a product into the topmost byte.
        passed = (u[:, None] > table.shares[row]).view(np.uint64)
        pick = ((passed[:, 0] + passed[:, 1]) * BYTES >> np.uint64(56)).astype(np.int64)
        ids.append(table.ids[table.entries[row, pick]])
        owners.append(live)
        counts[live] += 1
        at[live] = row - pick
        live = live[at[live] > first[live]]
    out = np.empty(int(counts.sum()), dtype=np.int32)
    stop = np.cumsum(counts)
    for turn, (some, who) in enumerate(zip(ids, owners)):
        out[stop[who] - 1 - turn] = some
    return out, counts


def sections(text: str, size: int = GROUP) -> Iterator[str]:
    """A prepared text in parts of about ``size`` characters, cut where chunks begin."""
    start = 0
    while len(text) - start > size:
        cut = text.find(SPACE, start + size)
        while cut > 0 and text[cut - 1] == SPACE:
            cut = text.find(SPACE, cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def prepared(text: str) -> str:
    if SPACE in text:
        text = text.replace(SPACE, "".join(chr(BYTE_BASE + b) for b in SPACE.encode()))
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_texts(lattice: Lattice, texts: list[str], keys: list[int], tables: Tables | None = None) -> list[np.ndarray]:
    """The sampled piece ids of each text; texts are taken together up to ``GROUP`` characters."""
    tables = tables or Tables(lattice)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    chunks: list[str] = []
    owners: list[tuple[int, int, int]] = []  # (text, chunks, place of the first)

    def flush() -> None:
        if not chunks:
            return
        which = tables.places_of(chunks)
        counts = np.array([n for _, n, _ in owners], dtype=np.int64)
        widths = 4 * tables.sizes[which] + 1
        ends = np.concatenate([[0], np.cumsum(widths)])
        base = np.array([place for _, _, place in owners], dtype=np.int64) - ends[np.cumsum(counts) - counts]
        places = ends[:-1] + np.repeat(base, counts)
        own = np.repeat(np.array([keys[t] for t, _, _ in owners], dtype=np.uint64), counts)
        ids, sizes = sample(tables, which, own, places)
        per = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        for (t, _, _), some in zip(owners, np.split(ids, np.cumsum(per)[:-1])):
            parts[t].append(some)
        chunks.clear()
        owners.clear()

    held = 0
    for t, text in enumerate(texts):
        place = 0
        for section in sections(prepared(text)) if text else ():
            some = CHUNKS.findall(section)
            owners.append((t, len(some), place))
            chunks.extend(some)
            place += 5 * len(section) + 1
            held += len(section)
            if held > GROUP:
                flush()
                held = 0
    flush()
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in parts]


class Decoder:
    """Ids back to text."""

    def __init__(self, vocabulary: dict) -> None:
        spelled = [b""] * vocabulary["size"]
        for name, i in vocabulary["pieces"].items():
            if ord(name[0]) < BYTE_BASE:
                spelled[i] = name.replace(SPACE, " ").encode()
        for b, i in enumerate(vocabulary["bytes"]):
            spelled[i] = bytes([b])
        self.spelled = spelled

    def text(self, ids) -> str:
        """The text without the leading space that encoding adds."""
        whole = b"".join(map(self.spelled.__getitem__, ids))
        return whole[1:].decode() if whole else ""


def row_key(seed: int, key) -> int:
    return xxhash.xxh64_intdigest(repr(key).encode(), seed=seed)


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
           model_file: str = MODEL_FILE, alpha: float = 1.0, seed: int = 0, check: bool = True) -> DataFrame:
    """The kept columns (default: the key) with n_pieces, piece_ids and, if ``check``, lossless: whether
    the decoded pieces equal the text."""
    keep = [c for c in keep or [key_col] if c not in ("n_pieces", "piece_ids", "lossless")]
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)],
                       F.col(key_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = Lattice(shared.value, alpha), Decoder(shared.value)
        tables = Tables(lattice)
        names = [f"_{k}" for k in range(width)] + ["n_pieces", "piece_ids"] + ["lossless"] * check
        for batch in batches:
            keys = [row_key(seed, key) for key in batch.column(width).to_pylist()]
            start = 0
            while start < batch.num_rows:
                texts, weight = [], 0
                while start + len(texts) < batch.num_rows and weight <= GROUP:
                    texts.append(batch.column(width + 1)[start + len(texts)].as_py())
                    weight += len(texts[-1])
                found = encode_texts(lattice, texts, keys[start:start + len(texts)], tables)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                columns = [c.slice(start, len(texts)) for c in batch.columns[:width]]
                columns += [pa.array(np.diff(offsets).astype(np.int64)), lists]
                if check:
                    columns.append(pa.array([decoder.text(x.tolist()) == text for x, text in zip(found, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start += len(texts)

    kinds = dict(docs.dtypes)
    schema = "".join(f"_{i} {kinds[c]}, " for i, c in enumerate(keep)) + "n_pieces long, piece_ids array<int>"
    out = rows.mapInArrow(run, schema + (", lossless boolean" if check else ""))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_pieces", "piece_ids",
                      *(["lossless"] if check else []))


def decode(encoded: DataFrame, ids_col: str = "piece_ids", out_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """Adds the text of the pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        decoder = Decoder(shared.value)
        return ids.map(lambda x: decoder.text([] if x is None else x))

    return encoded.withColumn(out_col, text_of(F.col(ids_col)))

