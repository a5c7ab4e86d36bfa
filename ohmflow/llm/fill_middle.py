"""Fill-in-middle transformation by in-place block rotation.

A text is cut at two unit boundaries into prefix, middle and suffix.  Units are
runs of A-Z and a-z, and single other code points; one scan of a slice's bytes
finds all units of its rows.  The three sentinels are inserted into one
bytearray, ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, and the segments change places in
it by rotations: a rotation is three reversals (left part, right part, both),
done by swapping blocks of at most ``SWAP`` bytes from the two ends, so nothing
but the one buffer grows with the text.

    psm  rotates middle and suffix:             ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
    spm  rotates suffix before prefix, middle:  ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

``restore`` finds the sentinels (a text that holds one is never transformed),
rotates back and takes the sentinels out, which gives the text exactly.

Cuts and forms depend on sha256 of ``seed:doc_id`` alone, so a repeated task
gives the same rows.  Every row is its own work: no shuffle, and a task holds
one slice of rows (0.25 MB of text, or one longer text).

Defined results: null and empty texts are plain and empty; a text that contains
a sentinel is plain; both cuts may fall together or at an end (empty parts); a
null doc_id is hashed as an empty number; repeated rows and ids give repeated
results; an empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import table

P, S, M = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 1, 90, 20
SWAP = 1 << 16
_LETTER = tk.byte_class((0x41, 0x5A), (0x61, 0x7A))


def reverse(view: np.ndarray) -> None:
    """Reverse the bytes of ``view`` in place, a block from either end at a time."""
    lo, hi = 0, len(view)
    while hi - lo > 1:
        n = min(SWAP, (hi - lo) // 2)
        left = view[lo:lo + n].copy()
        view[lo:lo + n] = view[hi - n:hi][::-1]
        view[hi - n:hi] = left[::-1]
        lo, hi = lo + n, hi - n


def rotate(buffer: bytearray, start: int, mid: int, end: int) -> None:
    """Exchange buffer[start:mid] and buffer[mid:end] in place by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    for a, b in ((start, mid), (mid, end), (start, end)):
        reverse(view[a:b])


def arrange(text: bytes, cut1: int, cut2: int, form: str) -> bytes:
    """The text with sentinels, in the order of ``form``; cuts are byte places."""
    buffer = bytearray(text)
    for at, mark in ((cut2, S), (cut1, M), (0, P)):          # from the right, so that places stay
        buffer[at:at] = mark
    middle, suffix = cut1 + len(P), cut2 + len(P) + len(M)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def unarrange(output: bytes, form: str) -> bytes:
    """The text that ``arrange`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    p, s, m = (output.index(x) for x in (P, S, M))
    if form == "psm":                                        # <P> p <S> s <M> m: swap the last two back
        rotate(buffer, s, m, len(buffer))
        middle, suffix = s, s + len(buffer) - m
    else:                                                    # <S> s <P> p <M> m: suffix to the end
        rotate(buffer, s, p, len(buffer))
        middle, suffix = m - p, len(buffer) - p
    for at, mark in ((suffix, S), (middle, M), (0, P)):
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all units, and each row's first unit (one entry more than rows)."""
    letter = _LETTER[data]
    inside = np.zeros(len(data), dtype=bool)                 # a letter that follows a letter of its row
    inside[1:] = letter[1:] & letter[:-1]
    inside[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(tk.LEAD[data] & ~inside)
    return starts, np.searchsorted(starts, offs)


def _drawn(doc_id, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def _transform(seed: int, rate: int, spm: int):
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            data, offs = tk.utf8(batch.column("text"))
            starts, first = units(data, offs)
            lead = tk.sums0(tk.LEAD[data].astype(np.int64))
            bounds = np.append(starts, len(data))
            ids = batch.column("doc_id").to_pylist()
            flat = data.tobytes()
            forms, prefix, middle, out = [], [], [], []
            for i, doc_id in enumerate(ids):
                lo, hi = int(offs[i]), int(offs[i + 1])
                text, n = flat[lo:hi], int(first[i + 1] - first[i])
                h = _drawn(doc_id, seed)
                if not text or h[2] % 100 >= rate or any(x in text for x in (P, S, M)):
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    out.append(text)
                    continue
                cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                a, b = (min(int(bounds[first[i] + k]), hi) for k in cuts)
                forms.append("spm" if h[3] % 100 < spm else "psm")
                prefix.append(int(lead[a] - lead[lo]))
                middle.append(int(lead[b] - lead[a]))
                out.append(arrange(text, a - lo, b - lo, forms[-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(first)), pa.array(forms, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(out, pa.binary()).cast(pa.string(), safe=False)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars, output.

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of these into spm, others into psm.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _transform(seed, rate, spm), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, "
        "prefix_chars long, middle_chars long, output string")


def _restore(batches):
    for batch in tk.chunked(batches, "output"):
        data, offs = tk.utf8(batch.column("output"))
        flat, forms = data.tobytes(), batch.column("form").to_pylist()
        texts = [unarrange(flat[offs[i]:offs[i + 1]], f or "plain") for i, f in enumerate(forms)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)],
                                         names=[*batch.schema.names, "restored"])


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of ``transform`` with the text that each output and form stand for, as ``restored``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(_restore, f"{kinds}, restored string")


def op11(spark, sf_dir: str) -> DataFrame:
    done = restore(transform(table(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id) AS x FROM documents),
h AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || x[1:8])::BIGINT AS h1,
             ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h3 % 100 >= {RATE} THEN 'plain'
                  WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
             array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
