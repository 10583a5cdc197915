"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
and / or / with in the tags' licence expressions.

Defined cases: a null text is the empty text; a text without words has no places and no labels; each place of a
phrase counts, overlapping or not; ties can't occur; an expression that can't be parsed to its end is evaluated up to
its last complete operand; an identifier that isn't known is its own label, lower-cased and without -only, -or-later
and +; a null doc_id stays null; repeated rows give repeated results; other columns of the input don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold

#: The base phrases: words, label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices that name a licence.
NOTICES = {
    "apache license 2 0": "apache-2", "apache 2 0 license": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3",
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu gpl v3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl-3", "mozilla public license": "mpl-2",
    "eclipse public license": "epl-2", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain dedication": "cc0",
    "the mit license": "mit", "mit licensed": "mit", "isc license": "isc", "boost software license": "bsl-1", "all rights reserved": "reserved",
}

#: Identifiers of tags, lower-cased and without -only, -or-later and +: label.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "isc": "isc", "zlib": "zlib", "bsl-1.0": "bsl-1",
    "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2", "epl-2.0": "epl-2",
    "cc0-1.0": "cc0", "unlicense": "unlicense", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd",
}

#: How freely a text under a licence may be used, from 0 to 1; an exception (with) lifts it to this at least.
FREEDOM = {
    "cc0": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "zlib": 1.0, "bsl-1": 1.0, "apache-2": 0.95, "bsd-2": 1.0, "bsd-3": 0.95, "cc-by": 0.9,
    "mpl-2": 0.7, "epl-2": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.1,
}
EXCEPTION = 0.8
UNKNOWN = 0.25

TAG = " spdx license identifier "
TAG_TEXT = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
PIECE = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
BINDS = {"or": 1, "and": 2, "with": 3}

#: A byte of UTF-8 to itself if it is part of a word, A-Z lower-cased, else to a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def to_rpn(text: str) -> list[str]:
    """Shunting-yard: a licence expression in reverse Polish order, operators in lower case; it ends where the text
    stops being an expression."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True
    while m := PIECE.match(text, at):
        paren, word = m.groups()
        low = (word or "").lower()
        if paren == "(" and operand:
            stack.append("(")
        elif paren == ")" and not operand and "(" in stack:
            while (x := stack.pop()) != "(":
                out.append(x)
        elif low in BINDS and not operand:
            while stack and BINDS.get(stack[-1], 0) >= BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif word and low not in BINDS and operand:
            out.append(word)
            operand = False
        else:
            break
        at = m.end()
    if operand and stack:  # the operator or parenthesis that has no operand yet
        while stack and stack[-1] == "(":
            stack.pop()
        if stack and out:
            stack.pop()
    return out + [x for x in reversed(stack) if x != "("] if out else []


def evaluate(rpn: list[str]) -> tuple[float, set[str]]:
    """The freedom that an expression grants (or: the larger, and: the smaller, with: an exception) and its labels."""
    stack: list[tuple[float, set[str]]] = []
    for x in rpn:
        if x in BINDS and len(stack) >= 2:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((max(a, b), left | right) if x == "or" else (min(a, b), left | right) if x == "and" else (max(a, EXCEPTION), left))
        elif x not in BINDS:
            low = re.sub(r"(-only|-or-later|\+)$", "", x.lower())
            label = IDENTIFIERS.get(low, low)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
    return stack[-1] if stack else (0.0, set())


def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces, and the tag's words."""
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, phrase in BASE))
    a.add_word(TAG, (3, "", False))
    a.make_automaton()
    return a


def scan_text(text: str, phrases: ahocorasick.Automaton) -> dict:
    """One text's words, places, labels and statements."""
    words = text.encode("utf-8", "replace").translate(_BYTES).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    places, labels, base, grants, tagged, before, n = [], set(), set(), [], False, 0, 0
    for end, (size, label, basic) in phrases.iter(joined):
        if not label:
            tagged = True
            continue
        n += joined.count(" ", before, end)  # spaces before the phrase's last one: words before its end
        before = end
        if basic:
            base.add(label)
            places.append((n - size, label))
        labels.add(label)
        grants.append(FREEDOM.get(label, UNKNOWN))
    expressions = []
    if tagged:
        for m in TAG_TEXT.finditer(text):
            if rpn := to_rpn(m[1]):
                grant, found = evaluate(rpn)
                expressions.append(" ".join(rpn))
                labels |= found
                grants.append(grant)
    return {
        "n_words": len(words), "places": places, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
        "expressions": expressions, "score": min(grants, default=0.0),
    }


SCHEMA = "n_words long, places array<struct<word: long, label: string>>, base_labels string, labels string, expressions array<string>, score double"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, places of base phrases, base_labels, labels, expressions in reverse Polish order, score).

    score is the freedom that all statements of a text grant together: the least of them, 0 without a statement.
    One pass without shuffle; a worker holds the texts of one Arrow batch.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in fold(texts, len):
                rows = [scan_text(t, phrases) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(i, j - i), pa.array([r["n_words"] for r in rows], pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in r["places"]] for r in rows], place),
                    *(pa.array([r[c] for r in rows], pa.string()) for c in ("base_labels", "labels")),
                    pa.array([r["expressions"] for r in rows], pa.list_(pa.string())), pa.array([r["score"] for r in rows], pa.float64()),
                ], names=list("abcdefg"))

    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
