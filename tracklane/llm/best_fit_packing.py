"""Packing token sequences: best fit, then swap-based local search.

Texts become token ids (white space parts words for the tokenizer, so ids are
looked up word by word and only new ones are encoded), end with id 0 and are
cut only where longer than a sequence. Pieces are dealt to groups of about
`group_size`; each group is packed best-fit-decreasing, then underfull bins
exchange pieces: a move, one for one or two for one, whenever it makes the
fuller bin fuller, which raises the sum of squared fills, until the emptiest bins
have gone or no exchange between any two of them gains. Bins that stay underfull in any group are pooled and
packed once more in groups.

Edge cases: null text is empty and gives one piece of id 0; repeated rows give
repeated pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import heapq
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._graph import checkpoint

PIECES = "doc_id bigint, rid bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Words kept with their ids in a worker; beyond it the table starts anew.
CACHE = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters beyond these send a text the long way; these are normal, lowered alike everywhere, and part words alike.
_UNUSUAL = re.compile(r"[^\t-\r -~¡-¨ª-±´-¸º»¿-įĲ-ɏ]")
#: Fixed value: the tokenizer file's own pattern of what a text is parted into.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class WordIds(dict):
    """Ids of a lowered word, as little-endian bytes, by the tokenizer's own steps.

    A text is lowered and parted at white space. A new word is parted into runs of letters, digits or signs, and only
    new runs are encoded. A text with any unusual character, and any text with a
    tokenizer of other steps, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        parts = steps.get("pre_tokenizer") or {}
        self.by_words = (
            [n.get("type") for n in (steps.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("add_prefix_space")) for n in parts.get("pretokenizers", [])] == [("Split", _RUNS.pattern, None), ("ByteLevel", None, False)]
            and steps["model"].get("end_of_word_suffix") == "</w>"
        )

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        runs = None if word.isalpha() else _RUNS.findall(word)
        if runs and (len(runs) > 1 or runs[0] != word):
            out = b"".join([self[r] for r in runs])
        else:
            coded = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = [t.id for t in self.tokenize(coded)]
            out = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        self[word] = out
        return out

    def of(self, text: str) -> bytes:
        if not self.by_words or _UNUSUAL.search(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def pieces(documents: DataFrame, length: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, piece, start, length, ids_crc32 of every piece of every text."""
    path = tokenizer or default_tokenizer()
    zero = np.zeros(1, "<u4").tobytes()

    def cut(batches):
        gc.disable()  # the tables have no cycles, and looking for some takes a third of the time
        ids = WordIds(path)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                rows = {k: [] for k in ("row", "piece", "start", "length", "crc")}
                for i, text in enumerate(part["text"].to_pylist()):
                    raw = ids.of(text or "") + zero
                    n = len(raw) // 4
                    for p, s in enumerate(range(0, n, length)):
                        e = min(s + length, n)
                        rows["row"].append(i)
                        rows["piece"].append(p)
                        rows["start"].append(s)
                        rows["length"].append(e - s)
                        rows["crc"].append(zlib.crc32(raw[4 * s : 4 * e]))
                row = pa.array(rows["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(row), part["rid"].take(row), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["crc"], pa.int64())],
                    ["doc_id", "rid", "piece", "start", "length", "ids_crc32"],
                )

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into `lengths` (descending), each piece in the fullest bin that has room."""
    bins, room, open_ = [], [[] for _ in range(size + 1)], 0
    for i, n in enumerate(lengths):
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            b, r = len(bins), size
            bins.append([])
        bins[b].append(i)
        left = r - n
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins


def _exchange(give: list[int], take: list[int], free: int, lengths: list[int]) -> tuple[list[int], list[int]] | None:
    """(pieces that go over, pieces that come back) which leave the fuller bin fuller by as much as fits."""
    own = sorted(give, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in own]
    at = bisect.bisect_right(sizes, free) - 1
    if at >= 0:  # move
        return [own[at]], []
    found, most = None, 0
    for x in take:
        at = bisect.bisect_right(sizes, lengths[x] + free) - 1
        if at >= 0 and sizes[at] - lengths[x] > most:  # one for one
            most, found = sizes[at] - lengths[x], ([own[at]], [x])
        lo, hi = 0, len(own) - 1
        while lo < hi and most < free:  # two for one
            gain = sizes[lo] + sizes[hi] - lengths[x]
            if gain > free:
                hi -= 1
            else:
                if gain > most:
                    most, found = gain, ([own[lo], own[hi]], [x])
                lo += 1
    return found


class _Partners:
    """Of all open bins: for each length of a piece (0 stands for none), the bin with most room that holds one."""

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: list[int], size: int):
        self.bins, self.fill, self.lengths, self.size = bins, fill, lengths, size
        self.heaps = [[] for _ in range(size + 1)]
        self.room = np.zeros(size + 1, np.int64)
        self.open, self.kinds = set(), {}

    def put(self, b: int) -> None:
        """Adds a bin, or tells that its pieces have changed."""
        before = self.kinds.get(b, set())
        self.open.discard(b)
        self.kinds[b] = {0, *(self.lengths[i] for i in self.bins[b])}
        if self.bins[b] and self.fill[b] < self.size:
            self.open.add(b)
            for x in self.kinds[b]:
                heapq.heappush(self.heaps[x], (self.fill[b] - self.size, b))
        for x in before | self.kinds[b]:
            self._most(x)

    def drop(self, b: int) -> None:
        self.open.discard(b)
        for x in self.kinds.pop(b, ()):
            self._most(x)

    def _most(self, x: int) -> None:
        heap = self.heaps[x]
        while heap and not (heap[0][1] in self.open and x in self.kinds[heap[0][1]] and self.size - self.fill[heap[0][1]] == -heap[0][0]):
            heapq.heappop(heap)
        self.room[x] = -heap[0][0] if heap else 0

    def find(self, donor: int) -> int | None:
        """The open bin to which an exchange moves most of the donor's tokens; None where no bin gains by any."""
        own = np.array([self.lengths[i] for i in self.bins[donor]], np.int64)
        sizes, times = np.unique(own, return_counts=True)
        two = (sizes[:, None] + sizes)[np.triu_indices(len(sizes), 1)]
        give = np.unique(np.concatenate([sizes, two, 2 * sizes[times > 1]]))
        held = np.flatnonzero(self.room)
        at = np.searchsorted(give, held + self.room[held], "right") - 1
        gain = np.where(at >= 0, give[np.maximum(at, 0)] - held, 0)
        best = int(np.argmax(gain)) if len(gain) else 0
        return self.heaps[held[best]][0][1] if len(gain) and gain[best] > 0 else None


def swap_search(bins: list[list[int]], lengths: list[int], size: int, near: int = 64) -> list[list[int]]:
    """Exchanges between underfull bins, from the emptiest on, first with the `near` fullest, then with any of all others, until nothing gains or no fewer bins can hold all."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // size)
    left, gained = len(bins), True
    while gained and left > least:
        gained = False
        open_ = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < size), key=lambda k: fill[k])
        partners, waiting = _Partners(bins, fill, lengths, size), []
        reached = 0
        for k in open_:
            partners.put(k)

        def exchange(donor: int, b: int) -> bool:
            change = _exchange(bins[donor], bins[b], size - fill[b], lengths)
            if not change:
                return False
            out, into = change
            moved = sum(lengths[i] for i in out) - sum(lengths[i] for i in into)
            bins[b] = [i for i in bins[b] if i not in into] + out
            bins[donor] = [i for i in bins[donor] if i not in out] + into
            fill[b] += moved
            fill[donor] -= moved
            partners.put(b)
            return True

        for donor in open_:
            if fill[donor] > reached:
                for k in waiting:  # emptier than all donors to come, unless as full
                    if fill[k] < fill[donor]:
                        partners.drop(k)
                waiting = [k for k in waiting if fill[k] >= fill[donor]]
                reached = fill[donor]
            partners.drop(donor)
            more = True
            while more and bins[donor]:
                more = False
                for b in reversed(open_[-near:]):
                    if b in partners.open and b != donor and bins[donor] and fill[donor] <= fill[b] < size:
                        more |= exchange(donor, b)
                gained |= more
            while bins[donor] and (b := partners.find(donor)) is not None and exchange(donor, b):
                gained = True
            left -= not bins[donor]
            partners.put(donor)
            waiting.append(donor)
            if left <= least:
                break
    return [b for b in bins if b]


def _packed(pieces: DataFrame, group: str, size: int, salt: int, keep_from: float) -> DataFrame:
    """Each group's pieces with sequence_id, offset and fill of their bin."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("rid", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        bins = swap_search(best_fit(lengths, size), lengths, size)
        seq, off, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = (table["grp"][0].as_py() << 24) * 2 + salt
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = first + 2 * b, at
                at += lengths[i]
            fill[members] = at
        return table.select(["doc_id", "rid", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).append_column("fill", pa.array(fill))

    return pieces.withColumn("grp", F.expr(group).cast("long")).groupBy("grp").applyInArrow(pack, PIECES + ", sequence_id bigint, offset bigint, fill bigint")


def pack(documents: DataFrame, length: int = 2048, tokenizer: str | None = None, group_size: int = 20_000, underfull: float = 0.97, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = checkpoint(pieces(documents, length, tokenizer, **columns))
    n = found.count()
    groups = max(1, -(-n // group_size))
    deal = lambda g: f"pmod(xxhash64(rid, piece), {g})"
    first = _packed(found, deal(groups), length, 0, underfull)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if groups == 1:
        return first.select(columns)
    first = checkpoint(first)
    again = first.filter(F.col("fill") < underfull * length)
    pooled = max(1, -(-again.count() // group_size))
    second = _packed(again.drop("sequence_id", "offset", "fill"), deal(pooled), length, 1, underfull)
    return first.filter(F.col("fill") >= underfull * length).select(columns).unionByName(second.select(columns))
