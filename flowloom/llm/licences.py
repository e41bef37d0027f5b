"""Licence scan: known sentences become identifiers, rules are sequences of identifiers.

A text is cut into pieces at line ends and marks; normalised, one piece or
several in a row are a known licence sentence, as wrapped lines, ':' and ';'
cut sentences too. That gives the document a string of one symbol per piece.
Rules are ordered sequences of known sentences without gaps but list numbers;
the leftmost longest rule wins, so that a long licence is not also reported as
a short one that it contains. All of it is one expression over a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ascii_lower

# Sentences of public licences, normalised (a-z and 0-9, single spaces).
SENTENCES = {
    "mit-notice": "released under the mit license",
    "apache-notice": "licensed under the apache license version 2 0",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "mit-title": "mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-condition": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software"
    ),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your option "
        "any later version"
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose"
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer"
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"
    ),
}
# Ordered rules: licence, sentence identifiers.
RULES = (
    ("MIT", ("mit-notice",)),
    ("MIT", ("spdx-mit",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("BSD", ("bsd-grant", "bsd-source", "bsd-binary")),
)
# A line end, or white space behind a mark that ends a sentence.
SENTENCE_END = r"\n|[.:;!?][\x20\x09-\x0D]"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
OTHER = "-"
# Further pieces of a known sentence; pieces that are list numbers.
MORE, ITEM = "=", "#"
# Breaks between pieces of a normalised text: those that end a sentence, and those that a sentence may go on behind.
END, SOFT = "B", "S"


def symbols() -> dict[str, str]:
    return dict(zip(SENTENCES, SYMBOLS, strict=False))


def rule_patterns() -> list[tuple[str, str]]:
    """(symbols of a rule, licence), longest first."""
    of = symbols()
    return sorted((("".join(of[i] for i in ids), name) for name, ids in RULES), key=lambda r: (-len(r[0]), r[0]))


def _text_rules() -> list[tuple[str, str, str]]:
    """(symbols, regular expression over the symbol string, licence) of the rules, longest first."""
    out = [(p, f"{ITEM}?".join(f"{c}{MORE}*" for c in p), name) for p, name in rule_patterns()]
    # A wrapped sentence that begins with the whole sentence of a rule is that rule's too.
    of = symbols()
    for name, ids in RULES:
        for other, words in SENTENCES.items():
            if len(ids) == 1 and words.startswith(SENTENCES[ids[0]] + " "):
                out.append((of[other], f"{of[other]}{MORE}+", name))
    return out


def _known_sentence() -> str:
    """Regular expression of a known sentence in a text of pieces, behind a list number or not."""
    longest_first = sorted(SENTENCES.values(), key=lambda w: (-len(w), w))
    known = "|".join(w.replace(" ", f"[ {SOFT}]") for w in longest_first)
    return rf"(?<![a-z0-9 ])(?:\d{{1,3}} )?({known})(?![a-z0-9 ])"


def pieces(text: Column) -> Column:
    """The words of a text, a space between words of one piece, ``SOFT`` or ``END`` between pieces."""
    # Behind lower-casing, A-Z are free to mark the breaks.
    c = ascii_lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, r"[.!?][\x20\x09-\x0D]|\n(?=[^a-z0-9\n]*\n)", END)
    c = F.regexp_replace(c, SENTENCE_END, SOFT)
    c = F.regexp_replace(c, rf"[^a-z0-9{END}{SOFT}]+", " ")
    run = rf"[ {END}{SOFT}]*"
    c = F.regexp_replace(c, rf"(?<![ {END}{SOFT}]){run}{END}{run}", END)
    c = F.regexp_replace(c, rf"(?<![ {SOFT}])[ {SOFT}]*{SOFT}[ {SOFT}]*", SOFT)
    return F.btrim(c, F.lit(f" {END}{SOFT}"))


def sentence_string(text: Column) -> Column:
    """One symbol per piece that has a letter or digit: the known sentence's and ``MORE``, ``ITEM`` or ``OTHER``."""
    of = symbols()
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, of[name])])

    def others(gap: Column) -> Column:
        gap = F.regexp_replace(gap, r"(?<![a-z0-9 ])\d{1,3}(?![a-z0-9 ])", ITEM)
        return F.translate(F.regexp_replace(gap, "[a-z0-9 ]+", OTHER), END + SOFT, "")

    def symbol(hit: Column) -> Column:
        more = F.length(hit) - F.length(F.translate(hit, SOFT, ""))
        return F.concat(F.element_at(known, F.translate(hit, SOFT, " ")), F.repeat(F.lit(MORE), more))

    def marked(c: Column) -> Column:
        hits = F.regexp_extract_all(c, F.lit(_known_sentence()), F.lit(1))
        gaps = F.split(c, _known_sentence())
        return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: F.concat(
            others(x["gap"]), F.coalesce(symbol(x["hit"]), F.lit("")))), "")

    # One element, so that the pieces are made once.
    return F.element_at(F.transform(F.array(pieces(text)), marked), 1)


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, licences, n_sentences, n_known, spans`` per row of ``docs``.

    ``licences``: sorted distinct names, joined by commas, empty if none;
    ``spans``: matched rules as ``licence@first piece+number of pieces`` in text order, joined by commas; the
    numbers of sentences count pieces. The SQL twin knows sentences of one piece only. Empty and NULL texts have no sentence. Repeated rows are scanned each.
    """
    patterns = _text_rules()
    of_rule = F.create_map(*[F.lit(x) for p, _, name in patterns for x in (p, name)])
    rules = "|".join(p for _, p, _ in patterns)

    def licence(hit: Column) -> Column:
        return F.element_at(of_rule, F.translate(hit, MORE + ITEM, ""))

    found = docs.select("doc_id", sentence_string(F.col("text")).alias("s"))
    # Matches and the pieces between them, in order, give the places.
    matches = F.regexp_extract_all("s", F.lit(f"({rules})"), F.lit(1))
    between = F.split("s", f"(?:{rules})")
    lengths = F.transform(F.arrays_zip(between.alias("gap"), matches.alias("hit")), lambda x: F.length(x["gap"]) +
                          F.coalesce(F.length(x["hit"]), F.lit(0)))
    found = found.select("doc_id", "s", matches.alias("hits"), lengths.alias("lengths"))
    spans = F.transform("hits", lambda hit, i: F.concat(
        licence(hit), F.lit("@"),
        (F.aggregate(F.slice("lengths", 1, i + 1), F.lit(0), lambda a, b: a + b) - F.length(hit)).cast("string"),
        F.lit("+"), F.length(hit).cast("string")))
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("hits", licence))), ",")
        .alias("licences"), F.length("s").alias("n_sentences"),
        F.length(F.translate("s", OTHER + ITEM, "")).alias("n_known"), F.array_join(spans, ",").alias("spans"))
