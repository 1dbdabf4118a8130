"""Exact BPE over sentencepiece pieces by dynamic programming.

A sequence of pieces is the BPE encoding of a text if and only if every two neighbours encode to themselves, so the
encoding of each prefix is found from the encodings of shorter ones: the last piece of a prefix is the one piece that
ends there and agrees with the last piece of what remains. All spans of a batch are relaxed together, position by position.
"""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece

from tidemark.llm.common import mix

SPACE = "▁"
#: States beside the pieces' ids.
START, UNKNOWN = 65533, 65534
#: New spans are relaxed together up to so many bytes, as each character takes some hundred bytes of tables on the way.
SOLVED_BYTES = 128 << 10


class Vocabulary:
    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.pieces = [p.id_to_piece(k) for k in range(len(p))]
        ordinary = [k for k in range(len(p)) if not (p.is_byte(k) or p.is_control(k) or p.is_unknown(k) or p.is_unused(k))]
        self.score = {self.pieces[k]: p.get_score(k) for k in ordinary}
        self.ids = {self.pieces[k]: k for k in ordinary}
        self.byte_ids = np.array([p.piece_to_id(f"<0x{k:02X}>") for k in range(256)])
        self.longest = max(map(len, self.ids))
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(x) for x in self.ids if len(x) == 1]] = True
        self._fits: dict[int, bool] = {}
        self._trie()

    def _trie(self) -> None:
        """Children of trie nodes in an open-addressing table of (node, character) keys."""
        child, piece = {}, [-1]
        for text, k in self.ids.items():
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = k
        self.piece_at = np.array(piece)
        self.slots = 1 << int(len(child) * 3).bit_length()
        self.slot_key, self.slot_node = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        keys, nodes = np.array(list(child)), np.array(list(child.values()))
        at = self._slot(keys)
        while len(keys):
            at %= self.slots
            free = self.slot_key[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(at), bool)
            take[first] = True
            take &= free
            self.slot_key[at[take]], self.slot_node[at[take]] = keys[take], nodes[take]
            keys, nodes, at = keys[~take], nodes[~take], at[~take] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) % np.uint64(self.slots)).astype(np.int64)

    def child(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        keys = nodes << 21 | chars
        at, out = self._slot(keys), np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            got = self.slot_key[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_node[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
            at[todo] = (at[todo] + 1) % self.slots
        return out

    def merge(self, text: str) -> list[str]:
        """The plain BPE of a short text: best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def fits(self, u: int, t: int) -> bool:
        key = u << 16 | t
        known = self._fits.get(key)
        if known is None:
            if t == UNKNOWN:
                known = True
            elif u in (START, UNKNOWN):
                known = self.merge(self.pieces[t]) == [self.pieces[t]]
            else:
                known = self.merge(self.pieces[u] + self.pieces[t]) == [self.pieces[u], self.pieces[t]]
            if len(self._fits) > 500_000:
                self._fits.clear()
            self._fits[key] = known
        return known


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def trie_edges(v: Vocabulary, chars: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, piece) of every piece that occurs, found by walking the trie from all positions at once."""
    starts, lengths, found = [], [], []
    at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    for depth in range(v.longest):
        node = v.child(node, chars[at + depth])
        alive = node > 0
        at, node = at[alive], node[alive]
        piece = v.piece_at[node]
        hit = piece >= 0
        starts.append(at[hit])
        lengths.append(np.full(int(hit.sum()), depth + 1))
        found.append(piece[hit])
        alive = at + depth + 1 < limit[at]
        at, node = at[alive], node[alive]
        if not len(at):
            break
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


def relax(v: Vocabulary, chars: np.ndarray, first: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every prefix of every span: its token count, last piece and that piece's length. first: span starts, and the end.

    Prefix k of span s is at index first[s] + s + k. A character that no piece holds counts its UTF-8 bytes as tokens.
    """
    n_spans = len(first) - 1
    span = np.repeat(np.arange(n_spans), np.diff(first))
    unknown = np.flatnonzero(~v.known[chars])
    start, length, piece = (np.concatenate((x, y)) for x, y in zip(edges, (unknown, np.ones(len(unknown), np.int64), np.full(len(unknown), UNKNOWN)), strict=True))
    cost = np.ones(len(start), np.int64)
    cost[len(edges[0]) :] = 1 + (chars[unknown] > 0x7F) + (chars[unknown] > 0x7FF) + (chars[unknown] > 0xFFFF)
    depth = start - first[span[start]]
    order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 65536 else depth, kind="stable")
    start, length, piece, cost, depth = start[order], length[order], piece[order], cost[order], depth[order]
    origin = start + span[start]
    size = len(chars) + n_spans
    count, last, step = np.full(size, -1, np.int64), np.full(size, START, np.int64), np.zeros(size, np.int64)
    count[first[:-1] + np.arange(n_spans)] = 0
    steps = int(depth[-1]) + 1 if len(depth) else 0
    bounds = np.searchsorted(depth, np.arange(steps + 1))
    for k in range(steps):
        e = slice(bounds[k], bounds[k + 1])
        o = origin[e]
        keys = last[o] << 16 | piece[e]
        unique, inverse = np.unique(keys, return_inverse=True)
        fits = v._fits
        good = np.array([x if (x := fits.get(key)) is not None else v.fits(key >> 16, key & 0xFFFF) for key in unique.tolist()], bool)[inverse] & (count[o] >= 0)
        to = o[good] + length[e][good]
        count[to] = count[o[good]] + cost[e][good]
        last[to], step[to] = piece[e][good], length[e][good]
    return count, last, step


def backtrack(v: Vocabulary, chars: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids): the encodings of all spans, one after the other."""
    n = len(first) - 1
    base = first[:-1] + np.arange(n)
    at = base + np.diff(first)
    sizes = count[at]
    ids = np.zeros(int(sizes.sum()), np.int64)
    fill = np.cumsum(sizes)
    todo = np.flatnonzero(at > base)
    while len(todo):
        piece, back = last[at[todo]], step[at[todo]]
        plain = piece != UNKNOWN
        fill[todo[plain]] -= 1
        ids[fill[todo[plain]]] = piece[plain]
        for s in todo[~plain].tolist():
            raw = chr(chars[at[s] - s - 1]).encode()
            fill[s] -= len(raw)
            ids[fill[s] : fill[s] + len(raw)] = v.byte_ids[list(raw)]
        at[todo] -= back
        todo = todo[at[todo] > base[todo]]
    return sizes, ids


def in_turn(which: np.ndarray, width: np.ndarray, solve, most: int = SOLVED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) that solve(span numbers) gives, for some spans at a time: about most bytes, or one longer span."""
    sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto, lo = np.cumsum(width[which]), 0
    while lo < len(which):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        n, x = solve(which[lo:hi])
        sizes.append(n)
        values.append(x)
        lo = hi
    return np.concatenate(sizes), np.concatenate(values)


def span_chars(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chars, first, limit) of spans as sentencepiece sees them: spaces are marked, a row's first span gets one more."""
    raw = buf.tobytes()
    texts = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    texts = [(SPACE + x if lead else x).replace(" ", SPACE) for x, lead in zip(texts, leads.tolist(), strict=True)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    return chars, first, np.repeat(first[1:], sizes)
