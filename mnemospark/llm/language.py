"""Language identification: a byte convolutional network with filters of several widths."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.byte_net import ByteNet, labelled_sample

WINDOW = 256
#: What texts in none of the learned languages are called.
NONE = "und"
#: The probability of NONE from which a text is in none: of 6,000 texts of sf0.1 that were not learned from none has it.
LEAST_NONE = 0.99
LETTERS = re.compile(r"[^\W\d_]")
#: Scripts (first and last letter) and marks that texts in no learned language are made of.
SCRIPTS = [(0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
MARKS = "=+-*/_()[]{}<>;:,.!&|%$#@~^0123456789"


def strangers(texts: list[bytes], seed: int = 7) -> list[bytes]:
    """Texts in no language, one or two for each of texts: its letters exchanged for others throughout
    or dealt anew (what has the shape of words but another spelling), or made-up words of other letters
    or of syllables in the marks of code, digits in base 16, runs of marks with a letter."""
    r, out = random.Random(seed), []
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    for t in texts:
        s = t.decode(errors="ignore")
        found = sorted(set(s.lower()) & set(alphabet)) or ["a"]
        to = dict(zip(alphabet, r.sample(alphabet, 26), strict=True))
        to |= {k.upper(): v.upper() for k, v in to.items()} | {c: r.choice(alphabet) for c in set(s) if ord(c) > 127}
        ciphered = s.translate(str.maketrans(to))
        letters = LETTERS.findall(s)
        r.shuffle(letters)
        left = iter(letters)
        dealt = LETTERS.sub(lambda _: next(left), s)
        n, kind = max(len(s), 4), r.randrange(5)
        if kind == 0:
            a, b = r.choice(SCRIPTS)
            made = " ".join("".join(chr(r.randint(a, b)) for _ in range(r.randint(2, 9))) for _ in range(n // 8 + 1))
        elif kind == 1:
            made = "".join(r.choice("0123456789abcdef") for _ in range(n))
            made = made if r.random() < 0.5 else " ".join(made[i : i + 8] for i in range(0, n, 8))
        elif kind == 2:
            marks = r.sample(MARKS, r.randint(1, 6))
            made = "".join(r.choice(marks) for _ in range(n - 1)) + r.choice(found)
        elif kind == 3:
            made = "".join(r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiouy") + r.choice(["", "", r.choice(MARKS + " \n")]) for _ in range(n // 2))
        else:
            made = "".join(r.choice(alphabet + alphabet.upper() + "0123456789+/") for _ in range(n))
        # a text of one letter and the like stays as it is when its letters are dealt: no stranger
        out += [x.encode()[:WINDOW] for x in (r.choice([ciphered, ciphered, dealt]), made if r.random() < 0.5 else s) if x != s]
    return out


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 400, windows: int = 6, longest: int = 20_000, none: bool = False) -> ByteNet | None:
    """A network fitted on at most per_label documents of each non-null label, of each at most windows
    windows of WINDOW bytes, spread over the whole text (of one over longest characters, over stretches
    from its first to its last that have longest in all). None
    without labelled rows. With none, NONE is learned as a label too, from strangers to those texts."""
    marks = docs.select(F.col(key), F.col(label).cast("string").alias("label"))
    sample = labelled_sample(docs.where(F.col(text).rlike(r"\p{L}")), marks, key=key, text=text, per_label=per_label, longest=longest)
    if not sample:
        return None
    classes = sorted({y for y, _ in sample})
    texts, marks = [], []
    for y, t in sample:
        starts = range(0, max(len(t) - WINDOW // 2, 1), WINDOW)
        for i in list(starts)[:: -(-len(starts) // windows)]:
            texts.append(t[i : i + WINDOW])
            marks.append(classes.index(y))
    if none:
        r = random.Random(5)
        short = [(t[: r.randint(4, 60)], y) for t, y in zip(texts, marks, strict=True) if r.random() < 0.3]  # so that few words are no reason
        texts, marks = texts + [t for t, _ in short], marks + [y for _, y in short]
        if NONE not in classes:
            classes = [*classes, NONE]
        other = strangers(texts)
        texts, marks = texts + other, marks + [classes.index(NONE)] * len(other)
    net = ByteNet(classes, widths=(2, 3, 4), filters=12, block=WINDOW)
    return net.fit(texts, np.array(marks), epochs=5, batch=64)


def identify(docs: DataFrame, net: ByteNet | None, *, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row (with whole: all columns of docs, lang_pred, score): the likeliest learned label over all windows of the
    whole text (their scores are averaged before the softmax) and its probability. Where the network
    knows NONE, texts of which it has a probability of LEAST_NONE are `und` with score 0.

    Texts that are null or have no letter are `und` with score 0 too; so is every text without a
    network. Ties go to the label first in code point order. Repeated rows and null keys keep their
    rows, equal texts get equal results, an empty table gives none; other columns are ignored.
    Nothing is shuffled."""
    rows = docs if whole else docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    named, text = rows.columns if whole else ["doc_id"], text if whole else "text"
    if net is None:
        return rows.select(*named, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    p = net.scored(rows, text, "_p", keep=whole)
    known = [(c, F.element_at("_p", i + 1)) for i, c in enumerate(net.classes) if c != NONE or len(net.classes) == 1]
    names, chances = F.array(*[F.lit(c) for c, _ in known]), F.array(*[x for _, x in known])
    best, sure = F.array_max(chances), F.col("_letters")
    if NONE in net.classes:
        sure = sure & (F.element_at("_p", net.classes.index(NONE) + 1) < LEAST_NONE)
        best = best / F.greatest(F.aggregate(chances, F.lit(0.0), lambda a, x: a + x), F.lit(1e-300))  # among the languages
    return p.select(
        *named,
        F.when(sure, F.element_at(names, F.array_position(chances, F.array_max(chances)).cast("int"))).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(sure, best).otherwise(F.lit(0.0)).alias("score"),
    )
