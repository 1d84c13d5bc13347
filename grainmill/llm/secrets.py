"""Secret scan: fixed patterns, and strings that zstandard cannot compress where code speaks of secrets.

The patterns give the base spans. The method adds to them: a candidate is a long run of key characters that follows a
word of a sensitive context (or an assignment to a name) within a few characters. Its novelty is measured by compression
with a dictionary made of the text around it and of common identifiers: the bytes that the candidate adds to the
compressed surroundings, against its length. Prose, identifiers, paths and repeated values cost part of their length;
random key material costs all of it, or of a long key of a small alphabet what its characters cost in any order. What
reaches the threshold and touches no base span is reported. Every candidate within the reach of a context word is measured.

Whole texts, one pass, no shuffle. A long text is handled at once; dictionaries are a few KB around each candidate.
Defined results: a null text is empty and has no span; offsets are code points; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and the run of key characters that may follow.
CONTEXT = re.compile(r"(?:secret|token|passw|pwd|credential|api.?key|access.?key|private.?key|bearer|authorization|auth|signature|client.?id|session)", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
REACH = 64
AROUND = 2048
#: Bytes that a candidate must add for each of its characters.
NOVELTY = 0.9
#: Entropy of a candidate's characters, against that of its alphabet used evenly, from which it may be a key of a small alphabet.
EVEN = 0.9
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX ================ "
    b"function return import from class public private static const string value default config settings options request response "
    b"authorization authentication bearer basic access_key secret_key api_key client_id client_secret token_url refresh_token session_id "
    b"username password passwd credential example changeme your-token-here your_api_key placeholder localhost production development "
    b"getElementById addEventListener application/json content-type user_agent http:// https:// www. .com .org .net index.html "
)


def novelty(before: bytes, candidate: bytes, after: bytes) -> float:
    """Compressed bytes that the candidate adds, for each of its bytes, with its surroundings and the identifiers as dictionary."""
    around = zstandard.ZstdCompressionDict(IDENTIFIERS + after + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=around, write_checksum=False, write_content_size=False, write_dict_id=False)
    # The tail of what stands before is compressed with it, so that a match may run into the candidate.
    tail = before[-32:]
    return (len(pack.compress(tail + candidate)) - len(pack.compress(tail))) / max(1, len(candidate))


def is_novel(before: bytes, candidate: bytes, after: bytes, threshold: float) -> bool:
    """Whether it reaches the threshold: against its length, or, if its alphabet is used evenly, against its characters in another order."""
    found = novelty(before, candidate, after)
    if found >= threshold:
        return True
    counts, n = Counter(candidate).values(), len(candidate)
    if sum(c * math.log2(n / c) for c in counts) < EVEN * n * math.log2(len(counts)):
        return False
    # The coder of literals packs small alphabets: how well shows on the same characters, shuffled; some orders it leaves unpacked.
    return found >= threshold * min(novelty(before, bytes(random.Random(seed).sample(candidate, n)), after) for seed in range(4))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def novel_spans(text: str, base: list[tuple[int, int, str]], threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context that don't compress and don't touch a base span."""
    out: list[tuple[int, int, str]] = []
    done, at_base = 0, 0
    enc = lambda s: s.encode("utf-8", "surrogatepass")
    for word in CONTEXT.finditer(text):
        while m := CANDIDATE.search(text, max(word.end(), done), word.end() + REACH):
            done = end = CANDIDATE.match(text, m.start()).end()
            while at_base < len(base) and base[at_base][1] <= m.start():
                at_base += 1
            if any(a < end and m.start() < b for a, b, _ in base[at_base : at_base + 3]):
                continue
            value = text[m.start() : end]
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            if is_novel(enc(text[max(0, m.start() - AROUND) : m.start()]), enc(value), enc(text[end : end + AROUND]), threshold):
                out.append((m.start(), end, KINDS[3]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def _scan(threshold: float):
    def run(frames):
        for frame in frames:
            rows = []
            for text in frame["txt"]:
                base = base_spans(text)
                spans = base + novel_spans(text, base, threshold)
                count = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*count, joined(base), joined(spans)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, n_novel (long), base_spans, spans (kind:start:end, comma-joined)."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    found = rows.mapInPandas(_scan(threshold), "doc_id string, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op1_zstd_novelty_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel")

