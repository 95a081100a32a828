"""SentencePiece encoding and decoding: a Viterbi search that streams, over many streams at a time."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from presswerk.llm.common import bound_batches, in_groups, worker_state

SPACE = "▁"
#: How far an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Characters that each stream goes on by before it gives out what is certain.
ROUND = 64
#: Characters from which on a text is cut into several streams, where paths meet.
STRETCH = 1024


class PieceModel:
    """Pieces and scores of a SentencePiece model file with identity normalisation and a leading space.

    The pieces are a trie in arrays: from ``node`` the character of code ``c``
    leads to ``to[base[node] + c]`` if ``of[base[node] + c] == node``.
    """

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, own.unk_id(), np.uint32)
        lowest = 0.0
        for i in range(own.vocab_size()):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
                self.bytes_of.append(b"")
            else:
                score = own.get_score(i)
                lowest = min(lowest, score)
                self.scores[piece] = (score, i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.scores))
        self.unknown_score = lowest - UNKNOWN_PENALTY
        #: No piece goes on over a space, so that all paths meet before one.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self._trie()

    def _trie(self) -> None:
        alphabet = sorted({c for p in self.scores for c in p})
        self.code = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[float, int]] = [(np.nan, -1)]
        for piece, end in self.scores.items():
            node = 0
            for c in piece:
                c = int(self.code[ord(c)])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append((np.nan, -1))
                node = children[node][c]
            ends[node] = end
        self.score_of = np.array([s for s, _ in ends])
        self.id_of = np.array([i for _, i in ends], np.int32)
        # Rows of the nodes are laid over each other in one array, each moved to where its cells are free.
        size = 1 << (4 * len(children) + len(alphabet)).bit_length()
        self.base, self.of, self.to = np.zeros(len(children), np.int32), np.full(size + len(alphabet) + 1, -1, np.int32), np.zeros(size + len(alphabet) + 1, np.int32)
        taken, spot = bytearray(len(self.of)), 0
        for node in sorted(range(len(children)), key=lambda k: -len(children[k])):
            own = children[node]
            if not own:
                break
            while any(taken[spot + c] for c in own):
                spot = (spot * 5 + 0x3C6F) % size
            self.base[node] = spot
            for c, child in own.items():
                taken[spot + c] = 1
                self.of[spot + c], self.to[spot + c] = node, child
        # A node without children leads nowhere: its row is one that no node owns.


class Streams:
    """Segmentations with the largest sum of scores of many streams of codes, side by side.

    All streams go on by ROUND characters at a time.  A path can only go on from
    the last ``longest`` positions; where the best paths to all of these run
    through one boundary, what lies before it is final: the pieces up to there
    are given out and their back pointers are forgotten.  So what is kept of a
    stream is bounded by how far back its paths differ, not by its length.  Of
    equal paths the one whose last piece starts earlier wins.
    """

    def __init__(self, model: PieceModel, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Streams are ``codes[starts[k]:starts[k] + lengths[k]]``."""
        order = np.argsort(-lengths, kind="stable")
        self.m, self.codes, self.starts, self.lengths = model, codes, starts[order], lengths[order]
        self.kept = 0  # most positions that were held at a time

    def pieces(self):
        """(ends, ids) of pieces that have become final: positions in ``codes`` behind them, and -1 for an unknown character; in no order."""
        m, width = self.m, self.m.longest
        n = len(self.starts)
        best = np.full((n, width + ROUND), -np.inf)  # scores of the last ``width`` positions, and of this round's
        best[:, width - 1] = 0.0
        scores = np.full((ROUND + width, n, width), -np.inf)  # of pieces, by end, stream, and start from the earliest on
        ids = np.full((ROUND + width, n, width), -1, np.int32)
        back = np.zeros((0, n), np.int8)  # length of the last piece of the best path to positions after ``given``
        last = np.zeros((0, n), np.int32)
        given, floor = 0, np.zeros(n, np.int64)  # rows of ``back`` begin behind position ``given``; ``floor``: what each stream has given out
        at = 0
        while n:
            live = int(np.searchsorted(-self.lengths, -at, side="left"))  # streams with more than ``at`` characters come first
            if live < n:
                n = live
                if not n:
                    break
                best, back, last, floor = best[:n], back[:, :n], last[:, :n], floor[:n]
                scores, ids = np.ascontiguousarray(scores[:, :n]), np.ascontiguousarray(ids[:, :n])
            self._match(at, n, scores, ids)
            now_back, now_id = np.empty((ROUND, n), np.int8), np.empty((ROUND, n), np.int32)
            rows = np.arange(n)
            for t in range(ROUND):
                paths = best[:, t : t + width] + scores[t]
                pick = paths.argmax(axis=1)
                best[:, width + t] = paths[rows, pick]
                now_back[t] = width - pick
                now_id[t] = ids[t][rows, pick]
            back, last = np.concatenate([back, now_back]), np.concatenate([last, now_id])
            self.kept = max(self.kept, len(back))
            at += ROUND
            meet = self._meeting(back, given, at, floor)
            yield self._path(back, last, given, floor, meet)
            floor = meet
            going = floor[self.lengths[:n] > at]
            drop = int(going.min()) - given if len(going) else 0
            back, last, given = back[drop:], last[drop:], given + drop
            best[:, :width] = best[:, ROUND:]
            best[:, :width] -= np.maximum(best[:, :width].max(axis=1, keepdims=True), -1e300)
            for x, empty in ((scores, -np.inf), (ids, -1)):
                x[:width] = x[ROUND:]
                x[width:] = empty

    def _match(self, at: int, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Puts in the pieces that start at the positions ``at`` to ``at`` + ROUND."""
        m, width = self.m, self.m.longest
        room = self.lengths[:n, None] - at - np.arange(ROUND)  # characters from a position to its stream's end
        stream, step = np.nonzero(room > 0)
        room = room[stream, step]
        spot = self.starts[stream] + at + step
        flat_scores, flat_ids = scores.reshape(-1), ids.reshape(-1)
        cell = (step * n + stream) * width + width  # of a piece of length d: + d * (n * width - 1), as it ends d rows later
        cell -= n * width
        node, single = np.zeros(len(spot), np.int32), np.zeros(len(spot), bool)
        where = np.arange(len(spot))
        for d in range(1, width + 1):
            slot = m.base[node] + self.codes[spot + (d - 1)]
            on = m.of[slot] == node
            if d > 1:
                on &= room >= d
            on = np.flatnonzero(on)
            slot, spot, room, cell, where = slot[on], spot[on], room[on], cell[on], where[on]
            node = m.to[slot]
            got = m.score_of[node]
            full = np.flatnonzero(got == got)
            target = cell[full] + d * (n * width - 1)
            flat_scores[target] = got[full]
            flat_ids[target] = m.id_of[node[full]]
            if d == 1:
                single[where[full]] = True
            if not len(on):
                break
        lone = np.flatnonzero(~single)
        if len(lone):
            flat_scores[(step[lone] * n + stream[lone]) * width + width - 1] = m.unknown_score

    def _meeting(self, back: np.ndarray, given: int, at: int, floor: np.ndarray) -> np.ndarray:
        """For each stream the last boundary that the paths to all of its open positions run through; the end of one that has ended."""
        width, n = self.m.longest, back.shape[1]
        ended = self.lengths[:n] <= at
        spots = np.minimum(at - np.arange(width)[None, :], self.lengths[:n, None])
        spots[ended] = self.lengths[:n][ended][:, None]
        spots = np.maximum(spots, floor[:, None])
        rows = np.arange(n)
        while True:
            far = spots.max(axis=1)
            open_ = np.flatnonzero(spots.min(axis=1) < far)
            if not len(open_):
                return far
            part, most = spots[open_], far[open_]
            before = most - back[most - given - 1, rows[open_]]
            spots[open_] = np.where(part == most[:, None], before[:, None], part)

    def _path(self, back: np.ndarray, last: np.ndarray, given: int, floor: np.ndarray, meet: np.ndarray):
        """Pieces between ``floor`` and ``meet``."""
        spot, rows, ends, out = meet.copy(), np.arange(len(meet)), [], []
        while True:
            rows = rows[spot[rows] > floor[rows]]
            if not len(rows):
                break
            here = spot[rows]
            ends.append(self.starts[rows] + here)
            out.append(last[here - given - 1, rows])
            spot[rows] = here - back[here - given - 1, rows]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(ends), np.concatenate(out)


class PieceCoder:
    """Ids of whole texts, as little-endian unsigned 32-bit buffers, and texts of ids."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.kept = 0
        self.piece_bytes = np.frombuffer(b"".join(self.model.bytes_of), np.uint8)
        self.piece_sizes = np.array([len(b) for b in self.model.bytes_of])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def _streams(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the streams: a text each, and long texts in stretches.

        Where no piece goes on over a space, all paths meet before one that
        follows another character, whatever comes next: a text may be cut there.
        """
        starts = bounds[:-1]
        if self.model.cuts and len(points) and (np.diff(bounds) > STRETCH).any():
            space = points == ord(SPACE)
            cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            block = cut // STRETCH
            cut = cut[np.concatenate([[True], block[1:] != block[:-1]])] if len(cut) else cut
            size = np.diff(bounds)[np.searchsorted(bounds, cut, side="right") - 1]
            starts = np.union1d(starts, cut[size > STRETCH])
        starts = np.unique(starts)
        lengths = np.diff(np.concatenate([starts, bounds[-1:]]))
        return starts[lengths > 0], lengths[lengths > 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        m, marked = self.model, [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in marked])])
        codes = np.concatenate([m.code[points], np.zeros(m.longest, np.int32)])
        starts, lengths = self._streams(points, bounds)
        id_at = np.full(len(points) + 1, -2, np.int32)  # of the piece that ends at a position; -2: none does
        search = Streams(m, codes, starts, lengths)
        for ends, ids in search.pieces():
            id_at[ends] = ids
        self.kept = search.kept
        ends = np.flatnonzero(id_at > -2)
        ids, count = id_at[ends].astype(np.uint32), np.ones(len(ends), np.int64)
        unknown = np.flatnonzero(id_at[ends] == -1)
        if len(unknown):
            raw = [chr(p).encode("utf-8", "replace") for p in points[ends[unknown] - 1]]
            count[unknown] = [len(b) for b in raw]
            ids = np.repeat(ids, count)
            first = (np.cumsum(count) - count)[unknown]
            own = np.concatenate([np.arange(a, a + len(b)) for a, b in zip(first, raw)])
            ids[own] = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(ends, bounds, side="right")]
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(upto[:-1], upto[1:])]

    def decode(self, ids) -> str:
        """The text of ids; one leading space is the model's own.  Bytes that are not UTF-8 become U+FFFD; ids beyond the model are skipped."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.piece_sizes))]
        size = self.piece_sizes[ids]
        total = int(size.sum())
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.piece_starts[ids], size)
        return self.piece_bytes[at].tobytes().removeprefix(b" ").decode("utf-8", "replace")


def piece_coder(path: str) -> PieceCoder:
    return worker_state(("pieces", path), lambda: PieceCoder(path))


def encode(spark: SparkSession, docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids binary) of every row, from its whole text.

    Null and empty texts have no ids.  Repeated rows give a row each, a null id
    stays null, an empty table gives no rows; other columns are not read.
    """
    bound_batches(spark)

    def run(batches):
        coder = piece_coder(model)
        for batch in batches:
            ids = [b for texts in in_groups(batch.column(1)) for b in coder.encode(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, text string, ids binary")


def decode(spark: SparkSession, coded: DataFrame, model: str, *, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids in a further column, which replaces one of that name; null ids give a null text.  Other columns stay as they are."""
    bound_batches(spark)
    coded = coded.drop(into)
    where = coded.columns.index(ids_col)

    def run(batches):
        coder = piece_coder(model)
        for batch in batches:
            texts = [None if not x.is_valid else coder.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{kinds}, `{into}` string")
