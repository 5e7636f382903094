"""Licence recognition by sentences and rules.

A text is cut into sentences, and a sentence is normalised to lower-case letters and digits with single spaces. Known
licence sentences have identifiers; one that is wrapped over lines, or has punctuation inside, is put together again
from the pieces it was cut into. A licence is an ordered list of identifiers, and it is recognised where these stand one
after the other; sentences that are not known break a sequence, copyright notices and the numbers of known clauses do
not. Rules are tried in their order, longer ones first, and each takes the sentences it has matched out of the sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of public licences, normalised, and which sentences make up which licence.
SENTENCES = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
     "and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not "
     "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other "
     "liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
     "software or the use or other dealings in the software"),
    ("mit-ref", "released under the mit license"),
    ("mit-ref", "licensed under the mit license"),
    ("mit-ref", "this project is licensed under the mit license"),
    ("apache-2-grant", "licensed under the apache license version 2 0 the license"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2-asis", "unless required by applicable law or agreed to in writing software distributed under the license "
     "is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2-ref", "licensed under the apache license version 2 0"),
    ("apache-2-ref", "released under the apache license version 2 0"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation either version 3 of the license or at your "
     "option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even "
     "the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("gpl-received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3-ref", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3-ref", "licensed under the gnu general public license version 3"),
    ("gpl-2-ref", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2-ref", "licensed under the gnu general public license version 2"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and "
     "the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions "
     "and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission"),
    ("cc-by-4-ref", "licensed under cc by 4 0"),
    ("cc-by-4-ref", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4-ref", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4-ref", "licensed under cc by nc 4 0"),
    ("cc0-ref", "released under cc0 1 0"),
    ("reserved", "all rights reserved"),
)
# Ordered rules, the more specific first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT-without-liability", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache-2-grant", "apache-2-comply", "apache-2-copy", "apache-2-asis", "apache-2-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-2-ref",)),
    ("GPL-3.0-only", ("gpl-3-ref",)),
    ("GPL-2.0-only", ("gpl-2-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("All-rights-reserved", ("reserved",)),
)
SENTENCE_END = r"([.!?:;])[ \t\r\n\f]+"
COPYRIGHT = r"^copyright (c )?[0-9]{4}.*$"
# The number or letter of a clause.
CLAUSE = r"(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[ |]"


def sentences(text: Column) -> Column:
    """Normalised sentences; one without a letter or digit of a-z, 0-9 is left out.

    A sentence ends at a line end or at a mark of punctuation with white space behind it. A licence's own colons and
    semicolons separate its clauses in the same way.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1\n"), "[\r\n]+")
    plain = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.array_remove(plain, "")


def joined(normal: Column) -> Column:
    """``normal`` with the pieces of a known sentence put together; its clause number, if it has one, goes.

    A known sentence begins and ends where pieces do. The longest known one wins; other pieces stay as they are.
    """
    wordings = sorted({wording for _, wording in SENTENCES}, key=lambda w: (-len(w), w))
    known = "|".join(wording.replace(" ", "[ |]") for wording in wordings)
    # One of the groups is empty: 1 is a known sentence behind its number, 2 one piece.
    pieces = F.concat(F.lit("|"), F.array_join(normal, "|"), F.lit("|"))
    found = F.regexp_extract_all(pieces, F.lit(rf"\|(?:(?:{CLAUSE})?(?={known})|)((?:{known})|[^|]+)(?=\|)"), 1)
    return F.transform(found, lambda s: F.translate(s, "|", " "))


def identifiers(normal: Column) -> Column:
    """The identifier of each sentence: ``copyright`` for a notice, ``?`` if it is not known."""
    known = F.create_map(*[F.lit(v) for sid, wording in dict((w, s) for s, w in SENTENCES).items() for v in (sid, wording)])

    def name(sentence: Column) -> Column:
        return F.coalesce(F.try_element_at(known, sentence), F.when(sentence.rlike(COPYRIGHT), "copyright"), F.lit("?"))

    return F.transform(joined(normal), name)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_matches, unmatched) per document.

    ``sentence_ids``: known identifiers in their order; ``licenses``: names found, in rule order, each once;
    ``n_matches``: how often rules matched; ``unmatched``: known identifiers no rule has used. Lists are joined by
    commas. Null or empty text: no sentences, empty lists. Every row is judged on its own, whatever its id; other
    columns are ignored.
    """
    listed = docs.select(F.col(id_col).alias("doc_id"), identifiers(sentences(F.col(text_col))).alias("ids"))
    known = F.array_remove("ids", "?")
    # Copyright notices may stand anywhere. An unknown sentence, and whatever a rule has used, breaks a sequence.
    chain = F.concat_ws("", F.transform(F.array_remove("ids", "copyright"), lambda i: F.when(i == "?", "#").otherwise(
        F.concat(F.lit("<"), i, F.lit(">")))))
    out = listed.select("doc_id", F.size("ids").cast("long").alias("n_sentences"),
                        F.concat_ws(",", known).alias("sentence_ids"), chain.alias("chain_0"))
    hits = []
    for nth, (_, rule) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in rule)
        before = F.col(f"chain_{nth}")
        after = F.replace(before, F.lit(pattern), F.lit("#"))
        broken = F.length(F.replace(before, F.lit(pattern), F.lit("")))
        hits.append(((F.length(before) - broken) / len(pattern)).cast("long").alias(f"hits_{nth}"))
        out = out.withColumn(f"hits_{nth}", hits[-1]).withColumn(f"chain_{nth + 1}", after)
    names = list(dict.fromkeys(name for name, _ in RULES))
    found = [
        F.when(reduce(Column.__or__, [F.col(f"hits_{i}") > 0 for i, (n, _) in enumerate(RULES) if n == name]), name)
        for name in names
    ]
    left = F.filter(F.split(F.regexp_replace(f"chain_{len(RULES)}", "[#<]+", ""), ">"), lambda i: i != "")
    return out.select(
        "doc_id", "n_sentences", "sentence_ids", F.concat_ws(",", *found).alias("licenses"),
        reduce(Column.__add__, [F.col(f"hits_{i}") for i in range(len(RULES))]).alias("n_matches"),
        F.concat_ws(",", left).alias("unmatched"),
    )
