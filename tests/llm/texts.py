"""Small texts with every odd case, and plain versions of the rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [a + b + c for a in ("ta", "re", "mo", "li", "é", "su") for b in ("na", "ri", "ko", "ü", "pe") for c in ("x", "ns", "", "q")]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, hit_doc string, hit_text string, gone_units string, "
          "gone_doc int, met_doc string, text_key string, new_text string, label string, score string")


def shout(text):
    """``text`` with a-z in upper case."""
    return text.translate({v: k for k, v in UPPER.items()})


def words(text, lower=True):
    return WORD.findall((text or "").translate(UPPER) if lower else text or "")


def plain_words(text):
    return PLAIN_WORD.findall((text or "").translate(UPPER))


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def odd_texts(seed=1):
    """Texts that are null, empty, blank, short, long, equal, nearly equal, or of odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 4, 5, 6, 9, 12, 20, 25, 30, 40, 60, 90, 120, 200, 400)]
    out = [None, "", " ", "\n\t\r\x0b\x0c", "one", "One two", "a b c d", "A b c d e", "a b c d e", "x" * 3000, "\n".join(["same line of text"] * 4),
           "é ü ß ﬁ   日本語 テキスト 🙂🙂", "<|endoftext|> in <|endoftext|>", "tab\tand  two   blanks \n\n end ", "trailing blank ", " leading"]
    for text in base:
        out += [text, text, text.upper(), changed(rng, text, 0.01), changed(rng, text, 0.04), changed(rng, text, 0.3)]
    shared = prose(rng, 55)
    out += [f"{prose(rng, 30)}\n{shared}\n{prose(rng, 20)}" for _ in range(4)]
    out.append(prose(rng, 6000))
    return out


def documents(spark, texts=None):
    """Rows of SCHEMA: a repeated row, a null doc_id, null hosts and clashing column names among them."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 3}", None if t is None else len(t), "h", None, "g", 7, "m", "k", "n", "l", "s")
            for i, t in enumerate(texts)]
    if rows:
        rows += [rows[-1], rows[-1], (None, rows[0][1], *rows[0][2:]), (None, None, *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
