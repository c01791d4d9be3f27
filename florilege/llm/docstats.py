"""Counts over whole texts that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

from florilege.llm.textkernels import Words, distinct_per_doc, line_counts, per_doc, repeat_words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def rule_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document, all int64."""
    raw, at = words.raw, words.at
    _, dup = line_counts(words)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_doc(words.body & ((raw & 0xC0) != 0x80), at),
        "n_symbols": per_doc(_SYMBOL[raw], at),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": repeat_words(words).astype(np.int64),
    }


def extra_counts(words: Words) -> dict[str, np.ndarray]:
    """Further counts of each document: lines with a word, upper-case and lower-case ASCII letters, marks, digits, distinct words."""
    raw, at = words.raw, words.at
    lines, _ = line_counts(words)
    return {
        "n_lines": lines.astype(np.int64),
        "n_upper": per_doc((raw >= 65) & (raw <= 90), at),
        "n_lower": per_doc((raw >= 97) & (raw <= 122), at),
        "n_marks": per_doc((raw == 33) | (raw == 63), at),
        "n_stops": per_doc((raw == 44) | (raw == 46), at),
        "n_digits": per_doc((raw >= 48) & (raw <= 57), at),
        "n_distinct": distinct_per_doc(words.doc, words.hashes, words.n_docs).astype(np.int64),
    }
