"""Fill-in-the-middle documents by displacement scatter (operator 12).

The texts of a batch lie one behind the other in one byte array. A scan finds the line ends and
with them the two cuts of every text; a difference array holds, at the first byte of every prefix, middle and suffix, by how
much the shift to the output changes there. Its cumulative sum is every byte's shift, and one numpy scatter builds
all outputs. Restoring scans the outputs for their marks, builds the same kind of array over the restored bytes and gathers.
Both work in stretches of bounded size, so memory follows the texts and not eight times their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import CHUNK, groups

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], object)
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"


def limits(parts: Sequence[bytes]) -> np.ndarray:
    """Where each part starts when they lie one behind the other, with the end as last value."""
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return out


def shifts(starts: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, places + shift) of bytes 0 to ``size``, in stretches.

    ``shift[i]`` holds from ``starts[i]`` on, of equal starts the last; ``starts`` ascend from 0.
    """
    jump = np.diff(shift, prepend=0)
    carry = 0
    for low in range(0, size, CHUNK):
        high = min(size, low + CHUNK)
        a, b = np.searchsorted(starts, [low, high])
        change = np.zeros(high - low, np.int64)
        np.add.at(change, starts[a:b] - low, jump[a:b])
        change[0] += carry
        displacement = np.cumsum(change)
        carry = int(displacement[-1])
        places = np.arange(low, high)
        yield places, places + displacement


def cut_lines(buf: np.ndarray, at: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of lines of every text, and the bytes where its prefix and its middle end."""
    ends = np.flatnonzero(buf == 10)
    first, last = np.searchsorted(ends, at[:-1]), np.searchsorted(ends, at[1:])
    filled = at[1:] > at[:-1]
    rest = filled.copy()
    rest[filled] = buf[at[1:][filled] - 1] != 10  # a last line without a line end
    n = last - first + rest

    def place(k: np.ndarray) -> np.ndarray:
        out = at[:-1].copy()
        inner = (k > 0) & (k <= last - first)
        out[inner] = ends[first[inner] + k[inner] - 1] + 1
        out[k > last - first] = at[1:][k > last - first]
        return out

    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    return n, place(np.minimum(one, two)), place(np.maximum(one, two))


def build(texts: list[bytes], draws: np.ndarray, rate: int, spm: int, marks: tuple[bytes, bytes, bytes]):
    """(n, form, cuts, outputs) of a group of texts; ``draws`` holds four numbers per text."""
    at = limits(texts)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n, one, two = cut_lines(buf, at, draws)
    form = np.where(draws[:, 3] % 100 < spm, SPM, PSM)
    form[draws[:, 2] % 100 >= rate] = PLAIN
    form[[not t or any(m in t for m in marks) for t in texts]] = PLAIN
    plain = form == PLAIN
    # A plain text is all suffix, without marks.
    begin = at[:-1]
    one, two = np.where(plain, begin, one), np.where(plain, begin, two)
    p, s, m = (np.where(plain, 0, len(x)) for x in marks)
    out_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(at[1:] - begin + p + s + m, out=out_at[1:])
    n_prefix, n_suffix = one - begin, at[1:] - two
    swapped = form == SPM
    # Where the marks stand; the texts follow them.
    mark_p = out_at[:-1] + np.where(swapped, s + n_suffix, 0)
    mark_s = out_at[:-1] + np.where(swapped, 0, p + n_prefix)
    mark_m = out_at[:-1] + p + s + n_prefix + n_suffix
    starts = np.column_stack([begin, one, two]).ravel()
    shift = np.column_stack([mark_p + p - begin, mark_m + m - one, mark_s + s - two]).ravel()
    out = np.zeros(out_at[-1], np.uint8)
    for places, to in shifts(starts, shift, len(buf)):
        out[to] = buf[places]
    for where, mark in zip((mark_p, mark_s, mark_m), marks):
        for i, byte in enumerate(mark):
            out[where[~plain] + i] = byte
    return n, form, (one, two), [out[a:b].tobytes() for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist())], (buf, begin)


def restore_group(outputs: list[bytes], form: np.ndarray, marks: tuple[bytes, bytes, bytes]) -> list[bytes]:
    """The texts from outputs and forms alone."""
    at = limits(outputs)
    buf = np.frombuffer(b"".join(outputs), np.uint8)
    prefix, suffix, middle = marks
    starts, shift, sizes, size = [], [], [], 0
    for begin, end, out, kind in zip(at[:-1].tolist(), at[1:].tolist(), outputs, form.tolist()):
        if kind == PLAIN:
            spans = [(begin, end)]
        elif kind == PSM:
            s, m = begin + out.index(suffix), begin + out.index(middle)
            spans = [(begin + len(prefix), s), (m + len(middle), end), (s + len(suffix), m)]
        else:
            p, m = begin + out.index(prefix), begin + out.index(middle)
            spans = [(p + len(prefix), m), (m + len(middle), end), (begin + len(suffix), p)]
        for a, b in spans:
            starts.append(size)
            shift.append(a - size)
            size += b - a
        sizes.append(size)
    back = np.zeros(size, np.uint8)
    for places, source in shifts(np.array(starts, np.int64), np.array(shift, np.int64), size):
        back[places] = buf[source]
    return [back[a:b].tobytes() for a, b in zip([0, *sizes[:-1]], sizes)]


def _code_points(part: np.ndarray) -> int:
    return sum(int(np.count_nonzero((part[i : i + CHUNK] & 0xC0) != 0x80)) for i in range(0, len(part), CHUNK))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, fim): the columns of every row, and its struct (n, form, prefix_chars, middle_chars, output).

    A text is cut between lines at two places drawn from the id and ``seed`` and put together as prefix, suffix, middle
    (psm) or, in ``spm`` of a hundred cases, as suffix, prefix, middle; ``rate`` of a hundred texts are
    transformed. Null and empty texts and texts that hold a mark stay plain, with null character counts. A null id draws like an
    empty one. Repeated rows give equal results, an empty table an empty one; columns of any name stay apart in ``row``.
    """
    coded = tuple(m.encode() for m in marks)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in batches:
            done: list[pd.DataFrame] = []
            at = 0
            for part in groups(b"" if t is None else t for t in texts):
                names = ids.iloc[at : at + len(part)]
                at += len(part)
                digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in names)
                draws = np.frombuffer(digests, ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
                n, form, (one, two), outputs, (buf, begin) = build(part, draws, rate, spm, coded)
                chars = [
                    (None, None) if f == PLAIN else (_code_points(buf[b:x]), _code_points(buf[x:y]))
                    for f, b, x, y in zip(form.tolist(), begin.tolist(), one.tolist(), two.tolist())]
                done.append(pd.DataFrame({
                    "n": n, "form": FORMS[form], "prefix_chars": pd.array([c[0] for c in chars], "Int64"),
                    "middle_chars": pd.array([c[1] for c in chars], "Int64"), "output": outputs}))
            yield pd.concat(done, ignore_index=True) if done else pd.DataFrame(columns=["n", "form", "prefix_chars", "middle_chars", "output"])

    made = F.pandas_udf(run, _RESULT)(F.col(text_col).cast("binary"), F.col(id_col).cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), made.alias("fim"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text (binary) of a transformed one, exactly, from its output and form."""
    coded = tuple(m.encode() for m in marks)
    code = {name: i for i, name in enumerate(FORMS)}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            done: list[bytes] = []
            for part in groups(outputs):
                done += restore_group(part, np.array([code[f] for f in forms.iloc[len(done) : len(done) + len(part)]]), coded)
            yield pd.Series(done, dtype=object)

    return F.pandas_udf(run, "binary")(output, form)
