"""Small tables with the awkward cases, and plain-Python versions of the definitions."""

import random
import re
import string

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# Columns whose names an operator might use for itself.
_INTERNAL = (
    "content _text _k0 _c0 start digest line _digest _kept_id kept_id row_digest copies _gone gone gone_id _body body "
    "_body_key _line_id row_key _cuts cuts _span_text span_id span_key _key _changes _pii_id pii_id row_id _id "
    "fp component n least hash_a unit first _n _spans _items item term score block ids"
).split()
CLASHING = "doc_id bigint, text string, lang string, n_words int, kept string, class_id string, " + ", ".join(
    f"{c} int" for c in _INTERNAL
)


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def table(spark, rows):
    """documents (doc_id, text) with further columns under clashing names."""
    full = [(d, t, "en", 7, "x", None, *range(len(_INTERNAL))) for d, t in rows]
    return spark.createDataFrame(full, CLASHING)


def prose(seed, n, vocabulary=4000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, empties, nulls, symbols, repeats and a long one."""
    rnd = random.Random(seed)
    rows = []
    for i in range(40):
        rows.append((i, prose(i, 30 + rnd.randrange(120))))
    for i in range(40, 60):  # near copies
        parts = rows[i - 40][1].split(" ")
        parts[rnd.randrange(len(parts))] = f"changed{i}"
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[0][1]), (61, rows[0][1]), (62, None), (63, ""), (64, "!!! ###"), (65, "One two")]
    rows += [(66, "One TWO"), (None, rows[3][1]), (None, None), (5, rows[5][1]), (67, prose(9, 20_000))]
    return rows
