"""Fill-in-the-middle by block rotations inside a byte array, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Bytes of texts that a task works on at a time.
HELD = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: bytes) -> np.ndarray:
    """Where the units of a text end: words with the white space before them, and white space at the end."""
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 if len(space) else np.zeros(0, np.int64)
    return np.r_[ends, len(space)] if len(space) and space[-1] else ends


def rotate(data: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange the blocks start … middle and middle … stop where they lie, by three reversals."""
    view = np.frombuffer(data, dtype=np.uint8)
    for i, j in ((start, middle), (middle, stop), (start, stop)):
        view[i:j] = view[i:j][::-1]


def arrange(data: bytes, first: int, second: int, form: str) -> bytes:
    """The text with its sentinels, cut at two bytes, in the order of the form."""
    out = bytearray(data)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the back, so that cuts stay right
        out[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle if form == PSM else 0, suffix, len(out))
    return bytes(out)


def rebuild(data: bytes, form: str) -> bytes:
    """The text of which :func:`arrange` made ``data``."""
    if form == PLAIN:
        return data
    out = bytearray(data)
    suffix, middle = data.index(SUFFIX), data.index(MIDDLE)
    # psm: prefix, suffix, middle; spm: suffix, prefix, middle. Turned back, the suffix is last.
    back = middle if form == PSM else data.index(PREFIX)
    length = back - suffix
    rotate(out, suffix, back, len(out))
    middle = suffix if form == PSM else middle - length
    for at, sentinel in ((len(out) - length, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del out[at : at + len(sentinel)]
    return bytes(out)


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input columns, the text, h1, h2, and whether suffix first and whether to leave the text; output without the last five."""
    for batch in batches:
        for i, j in slices([len(t) if t else 0 for t in batch.column(batch.num_columns - 5).to_pylist()], HELD):
            *others, texts, h1, h2, low, plain = batch.slice(i, j - i).columns
            rows = []
            for text, a, b, spm, leave in zip(texts.to_pylist(), h1.to_pylist(), h2.to_pylist(), low.to_pylist(), plain.to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                ends = unit_ends(data)
                n = len(ends)
                if leave or not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, PLAIN, None, None, text or ""))
                    continue
                first, second = (int(ends[k - 1]) if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))
                form = SPM if spm else PSM
                done = arrange(data, first, second, form).decode("utf-8", "surrogatepass")
                rows.append((n, form, len(data[:first].decode()), len(data[first:second].decode()), done))
            new = [pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*others, *new], [*batch.schema.names[:-5], *OUT])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices([len(t) if t else 0 for t in batch.column(batch.num_columns - 2).to_pylist()], HELD):
            *others, output, form = batch.slice(i, j - i).columns
            texts = []
            for text, kind in zip(output.to_pylist(), form.to_pylist()):
                texts.append(text if text is None else rebuild(text.encode("utf-8", "surrogatepass"), kind or PLAIN).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], [*batch.schema.names[:-2], "restored"])


OUT = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def _with(df: DataFrame, new: tuple[str, ...], run, more: list[Column], schema: str) -> DataFrame:
    """``df`` through ``run``, which sees ``more`` behind its columns and gives ``new`` in their place."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    done = flat.select("*", *more).mapInArrow(run, ", ".join([*[f"{n} {t}" for n, t in flat.dtypes], schema]))
    kept = [i for i, name in enumerate(names) if name.lower() not in new]
    return done.select(*[F.col(f"_c{i}").alias(names[i]) for i in kept], *new)


def transform(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``df`` and n_units, form, prefix_chars, middle_chars and output, the text in the order of its form.

    Units are words with the white space before them. Of hundred texts about ``rate`` are
    cut after two drawn numbers of units into prefix, middle and suffix, ``spm`` of hundred
    of these in the order suffix, prefix, middle, the others prefix, suffix, middle; each
    segment follows its sentinel. Draws depend on ``seed`` and the id alone (a null id
    counts as an empty one), so repeated rows and other tables agree. Empty texts and texts
    that hold a sentinel stay plain, as the others do; a null text is an empty one. Input
    columns called like the new ones are replaced; all others are kept.
    """
    columns = df.columns
    key, body = f"_c{columns.index(id_col)}", f"_c{columns.index(text)}"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    more = [F.col(body), h1, h2, h4 % 100 < spm, h3 % 100 >= rate]
    more = [c.alias(f"_m{i}") for i, c in enumerate(more)]
    return _with(df, OUT, _arranged, more, "n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` and ``restored``, the text before :func:`transform`, from output and form alone."""
    columns = df.columns
    more = [F.col(f"_c{columns.index(c)}").alias(f"_m{i}") for i, c in enumerate((output, form))]
    return _with(df, ("restored",), _rebuilt, more, "restored string")
