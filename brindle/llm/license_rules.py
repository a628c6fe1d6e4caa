"""Licence scans by sentence rules.

A text is normalised as a whole: lower case, words and version numbers only, line ends and comment
marks as spaces. Known sentences get an identifier wherever they stand in it at word bounds, across line
ends and behind the holder and years of a copyright line too. A document is then a sequence of identifiers, and ordered rules say which runs of them
make a licence: rules are tried from specific to general, each place belongs to the first rule that takes
it, and identifiers of a rule may have other known sentences between them. Most rules are of one sentence that names a
licence; those sentences are made of its names and the forms in which licences are named.

Names may follow each other after one form ("under the MIT License or the Apache License, Version 2.0"), each is found; a form that is
negated ("not licensed under") names nothing. Expressions of short names, in file headers or in brackets, are recorded as
written and stand for the header sentences of their names (one whose brackets don't close is no expression); a line that is a licence's title stands for a sentence that names it.

Defined cases: null and empty texts hold nothing; repeated rows are scanned each; a sentence may
be of any length; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier.
SENTENCES = {
    "mit.grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",),
    "mit.notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as.is": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",),
    "isc.grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "0bsd.grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "author.disclaims": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",),
    "bsd.use": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd.source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd.binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",),
    "bsd.endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd.advert": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "apache.comply": ("you may not use this file except in compliance with the License",),
    "apache.copy": ("You may obtain a copy of the License at",),
    "apache.as.is": ("distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "gpl.free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "lgpl.free": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "agpl.free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "v2.later": ("either version 2 of the License, or (at your option) any later version",),
    "v2.1.later": ("either version 2.1 of the License, or (at your option) any later version",),
    "v3.later": ("either version 3 of the License, or (at your option) any later version",),
    "gpl.receive": ("You should have received a copy of the GNU General Public License along with this program",),
    "mpl.subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl.copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "epl.made": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0"),
    "unlicense.free": ("This is free and unencumbered software released into the public domain",),
    "unlicense.anyone": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "boost.grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "zlib.held": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib.origin": ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software",),
    "wtfpl.do": ("You just DO WHAT THE FUCK YOU WANT TO",),
    "cc0.waive": ("dedicated to the public domain under CC0 1.0", "has waived all copyright and related or neighboring rights to this work"),
    "reserved": ("All rights reserved",),
    "proprietary": ("Unauthorized copying of this file, via any medium, is strictly prohibited", "Proprietary and confidential"),
}

# Licences by identifier of their name: (licence, kind, names, the short name of file headers).
NAMES = {
    "mit.name": ("MIT", "permissive", ("MIT License",), "MIT"),
    "isc.name": ("ISC", "permissive", ("ISC License",), "ISC"),
    "bsd3.name": ("BSD-3-Clause", "permissive", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"), "BSD-3-Clause"),
    "bsd2.name": ("BSD-2-Clause", "permissive", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"), "BSD-2-Clause"),
    "bsd.name": ("BSD", "permissive", ("BSD License",), None),
    "apache.name": ("Apache-2.0", "permissive", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), "Apache-2.0"),
    "agpl3.name": ("AGPL-3.0", "copyleft", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"), "AGPL-3.0-only"),
    "agpl3.later.name": ("AGPL-3.0-or-later", "copyleft", (), "AGPL-3.0-or-later"),
    "gpl3.name": ("GPL-3.0", "copyleft", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"), "GPL-3.0-only"),
    "gpl3.later.name": ("GPL-3.0-or-later", "copyleft", (), "GPL-3.0-or-later"),
    "gpl2.name": ("GPL-2.0", "copyleft", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"), "GPL-2.0-only"),
    "gpl2.later.name": ("GPL-2.0-or-later", "copyleft", (), "GPL-2.0-or-later"),
    "lgpl3.later.name": ("LGPL-3.0-or-later", "copyleft", (), "LGPL-3.0-or-later"),
    "lgpl2.later.name": ("LGPL-2.1-or-later", "copyleft", (), "LGPL-2.1-or-later"),
    "lgpl3.name": ("LGPL-3.0", "copyleft", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"), "LGPL-3.0-only"),
    "lgpl2.name": ("LGPL-2.1", "copyleft", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"), "LGPL-2.1-only"),
    "lgpl.name": ("LGPL", "copyleft", ("GNU Lesser General Public License",), None),
    "gpl.name": ("GPL", "copyleft", ("GNU General Public License",), None),
    "mpl.name": ("MPL-2.0", "copyleft", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"), "MPL-2.0"),
    "epl.name": ("EPL-2.0", "copyleft", ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"), "EPL-2.0"),
    "boost.name": ("BSL-1.0", "permissive", ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "BSL-1.0"),
    "zlib.name": ("Zlib", "permissive", ("zlib License",), "Zlib"),
    "unlicense.name": ("Unlicense", "permissive", ("Unlicense",), "Unlicense"),
    "wtfpl.name": ("WTFPL", "permissive", (), "WTFPL"),
    "ccbyncsa.name": ("CC-BY-NC-SA-4.0", "restricted", ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "CC-BY-NC-SA-4.0"),
    "ccbyncnd.name": ("CC-BY-NC-ND-4.0", "restricted", ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), "CC-BY-NC-ND-4.0"),
    "ccbync.name": ("CC-BY-NC-4.0", "restricted", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), "CC-BY-NC-4.0"),
    "ccbynd.name": ("CC-BY-ND-4.0", "restricted", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), "CC-BY-ND-4.0"),
    "ccbysa.name": ("CC-BY-SA-4.0", "copyleft", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), "CC-BY-SA-4.0"),
    "ccby.name": ("CC-BY-4.0", "permissive", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), "CC-BY-4.0"),
    "cc0.name": ("CC0-1.0", "permissive", ("CC0 1.0", "CC0 1.0 Universal"), "CC0-1.0"),
}
# Sentences that name a licence, and the line of a file's header. A sentence is made for each pair of name and form.
FORMS = ("licensed under {}", "licensed under the {}", "licensed under a {}", "licensed under the terms of the {}", "released under {}", "released under the {}", "released under the terms of the {}", "distributed under the {}", "distributed under the terms of the {}", "available under the {}", "published under the {}", "licensed under either {}", "licensed under either the {}", "licensed under either of the {}")
HEADER = "SPDX-License-Identifier: {}"
TITLES = {
    "mit.name": ("The MIT License (MIT)",),
    "apache.name": ("Apache License Version 2.0, January 2004",),
    "agpl3.name": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "gpl3.name": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "gpl2.name": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "lgpl3.name": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "lgpl2.name": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "epl.name": ("Eclipse Public License - v 2.0",),
    "boost.name": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}
# Words between names that follow each other, and words before a form that turn it round.
CONNECTORS = ("", "the", "and", "and a", "and the", "and under the", "or", "or a", "or the", "or under the", "and or the", "as well as the")
NEGATION = re.compile(r" (?:not|never|no longer|nor|isn t|aren t|wasn t)(?: be| been| currently| yet| also)? $")
# The header of an expression, its tokens, and expressions in brackets.
EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
SHORT_NAME = r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?"
TOKEN = re.compile(rf"[ \t]*(\(|\)|{SHORT_NAME})")
BRACKETS = re.compile(rf"\({SHORT_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{SHORT_NAME})+\)")
OPERATORS = ("AND", "OR", "WITH")

# Ordered rules of several sentences, (licence, kind, identifiers in their order); more come from NAMES.
TEXTS = (
    ("MIT", "permissive", ("mit.grant", "mit.notice", "as.is")),
    ("BSD-4-Clause", "permissive", ("bsd.use", "bsd.source", "bsd.binary", "bsd.advert")),
    ("BSD-3-Clause", "permissive", ("bsd.use", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", "permissive", ("bsd.use", "bsd.source", "bsd.binary")),
    ("ISC", "permissive", ("isc.grant", "author.disclaims")),
    ("0BSD", "permissive", ("0bsd.grant", "author.disclaims")),
    ("Apache-2.0", "permissive", ("apache.name", "apache.comply", "apache.copy", "apache.as.is")),
    ("Apache-2.0", "permissive", ("apache.name", "apache.comply", "apache.copy")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl.free", "v3.later")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl.free", "v3.later")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl.free", "v2.1.later")),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free", "v3.later", "gpl.receive")),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free", "v3.later")),
    ("GPL-2.0-or-later", "copyleft", ("gpl.free", "v2.later", "gpl.receive")),
    ("GPL-2.0-or-later", "copyleft", ("gpl.free", "v2.later")),
    ("MPL-2.0", "copyleft", ("mpl.subject", "mpl.copy")),
    ("Unlicense", "permissive", ("unlicense.free", "unlicense.anyone")),
    ("Zlib", "permissive", ("zlib.held", "zlib.origin")),
)
ALONE = (
    ("MIT", "permissive", ("mit.grant",)),
    ("ISC", "permissive", ("isc.grant",)),
    ("BSL-1.0", "permissive", ("boost.grant",)),
    ("AGPL", "copyleft", ("agpl.free",)),
    ("LGPL", "copyleft", ("lgpl.free",)),
    ("GPL", "copyleft", ("gpl.free",)),
    ("MPL-2.0", "copyleft", ("mpl.subject",)),
    ("EPL-2.0", "copyleft", ("epl.made",)),
    ("Unlicense", "permissive", ("unlicense.free",)),
    ("Zlib", "permissive", ("zlib.origin",)),
    ("WTFPL", "permissive", ("wtfpl.do",)),
    ("CC0-1.0", "permissive", ("cc0.waive",)),
    ("Proprietary", "restricted", ("proprietary",)),
    ("All-Rights-Reserved", "restricted", ("reserved",)),
)
# The order of kinds from lenient to strict.
KINDS = ("permissive", "copyleft", "restricted")


def known_sentences() -> dict[str, tuple[str, ...]]:
    """SENTENCES, and those that name a licence of NAMES."""
    out = dict(SENTENCES)
    for key, (_, _, names, short) in NAMES.items():
        said = [form.format(name) for name in names for form in FORMS]
        out[key] = (*said, *([HEADER.format(short)] if short else []), *TITLES.get(key, ()))
    return out


RULES = (*TEXTS, *((licence, kind, (key,)) for key, (licence, kind, _, _) in NAMES.items()), *ALONE)

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def normalised(sentence: str) -> str:
    """Words in lower case, one space between."""
    return " ".join(WORD.findall(sentence.lower()))


def hints(sentences: list[str]) -> list[str]:
    """Words of which every one of the normalised sentences holds one: the word that most sentences hold, then the one that
    most of the others hold, and so on. A text that holds none of them holds no sentence."""
    left, out = [set(t.split()) for t in sentences if t], []
    while left:
        count = Counter(w for words in left for w in words)
        best = max(count, key=lambda w: (count[w] * (len(w) > 2), len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def short_names() -> dict[str, str]:
    """Short names as headers spell them, by any spelling of theirs in lower case: a version alone is that version only, one with a
    plus sign that or a later one."""
    out = {short.lower(): short for _, _, _, short in NAMES.values() if short}
    for short in list(out.values()):
        for ending, alias in (("-only", ""), ("-or-later", "+")):
            if short.endswith(ending):
                out[short.removesuffix(ending).lower() + alias] = short
    return out


def expression_at(text: str, at: int, known: dict[str, str]) -> tuple[int, list[str], list[str]]:
    """(end, tokens, short names) of the longest expression that begins at a place: names joined by AND, OR and WITH, with brackets;
    end is the place itself if none does. Names that are not known stay in the tokens as they are, as do exceptions after WITH."""
    tokens: list[str] = []
    names: list[tuple[int, str]] = []
    best, depth, operand = (at, 0), 0, True  # operand: a name or an opening bracket has to follow
    end = at
    while token := TOKEN.match(text, end):
        word = token[1]
        if word == "(":
            if not operand or (tokens and tokens[-1] == "WITH"):
                break
            depth += 1
        elif word == ")":
            if operand or not depth:
                break
            depth -= 1
        elif word in OPERATORS:
            if operand:
                break
            operand = True
        elif not operand:
            break
        else:
            exception = bool(tokens) and tokens[-1] == "WITH"
            found = known.get(word.rstrip(".").lower())
            if found is None and word.endswith("+"):
                found = known.get(word[:-1].lower())
                word = word if found is None else found + "+"
            elif found is not None:
                word = found
            if found is not None and not exception:
                names.append((len(tokens), found))
            operand = False
        tokens.append(word)
        end = token.end()
        if not operand and not depth:
            best = (end, len(tokens))
    return best[0], tokens[: best[1]], [name for k, name in names if k < best[1]]


class Scanner:
    """Finds known sentences and the rules that their sequence fits."""

    def __init__(self, sentences: dict[str, tuple[str, ...]] | None = None, rules=RULES):
        self.inside = ahocorasick.Automaton()
        self.named = NAMES if sentences is None else {}
        self.short = short_names() if sentences is None else {}
        forms = {normalised(t): name for name, texts in (sentences or known_sentences()).items() for t in texts}
        for key, (_, _, names, short) in self.named.items():
            for name in (*names, *([short] if short else [])):
                for connector in CONNECTORS:
                    further = normalised(f"{connector} {name}")
                    self.inside.add_word(f" {further} ", (len(further) + 2, key, True))
        for text, name in forms.items():
            if text:
                self.inside.add_word(f" {text} ", (len(text) + 2, name, False))
        self.inside.make_automaton()
        self.hints = hints(list(forms))
        self.rules = rules
        titles = {name for _, _, names, _ in self.named.values() for name in names if name.endswith(("License", "Universal")) or "License," in name}
        either = "|".join(re.escape(t) for name in sorted(titles, key=lambda n: (-len(n), n)) for t in (name, name.upper()))
        self.titles = re.compile(rf"^[ \t#*/;%-]*(?:(?:The|THE) )?({either})(?: \(\w+\))?[ \t\r.:]*$", re.MULTILINE) if titles else None

    def spelled_out(self, text: str) -> tuple[str, list[str]]:
        """(text with header sentences for its expressions and naming sentences for its title lines, the expressions)."""
        if not self.named:
            return text, []
        found = []  # (start, end, tokens, short names)
        for header in EXPRESSION.finditer(text):
            end, tokens, names = expression_at(text, header.end(), self.short)
            if names and not (found and header.start() < found[-1][1]):
                found.append((header.start(), end, tokens, names))
        if "(" in text and any(f" {o} " in text for o in OPERATORS):
            taken = {place for start, end, _, _ in found for place in range(start, end)}
            for match in BRACKETS.finditer(text):
                end, tokens, names = expression_at(text, match.start(), self.short)
                wanted = sum(t not in (*OPERATORS, "(", ")") for t in tokens) - tokens.count("WITH")
                if match.start() not in taken and end == match.end() and len(names) == wanted:  # all names are known
                    found.append((match.start(), end, tokens[1:-1], names))
        parts, done = [], 0
        for start, end, _, names in sorted(found, key=lambda f: f[0]):
            parts += [text[done:start], " ".join(HEADER.format(name) for name in names)]
            done = end
        text = "".join([*parts, text[done:]])
        expressions = [" ".join(tokens).replace("( ", "(").replace(" )", ")") for _, _, tokens, _ in sorted(found, key=lambda f: f[0])]
        if "icense" in text or "ICENSE" in text:
            text = self.titles.sub(lambda m: f"Licensed under the {m[1]}", text)
        return text, expressions

    def identifiers(self, text: str) -> list[str]:
        """Identifiers of the known sentences of a text, in order."""
        return self.found(text)[0]

    def found(self, text: str) -> tuple[list[str], list[str]]:
        """(identifiers of the known sentences of a text, its licence expressions), both in order."""
        text, expressions = self.spelled_out(text)
        low = text.lower()
        if not any(h in low for h in self.hints):
            return [], expressions
        words = f" {normalised(low)} "
        out, end, naming, turned = [], -1, False, False
        # Of known sentences that overlap, the one that begins first, then the longest; further names only right behind one.
        for start, n, name, further in sorted((stop - n + 1, -n, name, further) for stop, (n, name, further) in self.inside.iter(words)):
            if start < end or (further and not (naming and start == end)):
                continue
            naming = name in self.named
            if not further:
                turned = naming and NEGATION.search(words[max(0, start - 40) : start + 1]) is not None
            if not turned:
                out.append(name)
            end = start - n - 1
        return out, expressions

    def licences(self, identifiers: list[str]) -> list[tuple[str, str]]:
        """(licence, kind) of the rules that match, each once, in the order of the rules."""
        left: list[str | None] = list(identifiers)
        out = []
        for licence, kind, wanted in self.rules:
            while True:
                places, at = [], 0
                for w in wanted:
                    while at < len(left) and left[at] != w:
                        at += 1
                    if at == len(left):
                        break
                    places.append(at)
                    at += 1
                if len(places) < len(wanted):
                    break
                for k in places:
                    left[k] = None
                if (licence, kind) not in out:
                    out.append((licence, kind))
        return out


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def sentences_of(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """Known sentences from a table (identifier, sentence); ValueError if there are more than MOST_SENTENCES. Rows with a null, or
    without a word, are left out."""
    rows = table.select("identifier", "sentence").dropna().distinct().orderBy("identifier", "sentence").limit(MOST_SENTENCES + 1).collect()
    if len(rows) > MOST_SENTENCES:
        raise ValueError(f"more than {MOST_SENTENCES} sentences")
    out: dict[str, tuple[str, ...]] = {}
    for r in rows:
        if normalised(r["sentence"]):
            out[r["identifier"]] = (*out.get(r["identifier"], ()), r["sentence"])
    return out


MOST_SENTENCES = 100_000


def scan(docs: DataFrame, sentences: dict[str, tuple[str, ...]] | None = None, rules=RULES) -> DataFrame:
    """doc_id, licences (comma-separated, in the order of the rules), strictest kind (null: none; alternatives of an expression
    are counted as named), sentences (identifiers in order, comma-separated), their number, and expressions (as written, with short names
    spelled as in headers; semicolons between), for every row. Nothing is shuffled. Own sentences, e.g. sentences_of(table),
    and rules over their identifiers take the place of the known ones."""

    shipped = sentences is None and rules is RULES

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner() if shipped else Scanner(sentences, rules)
        for batch in batches:
            names, kinds, known, n, said = [], [], [], [], []
            for value in batch.column(1):
                ids, expressions = s.found(value.as_py() or "")
                matched = s.licences(ids) if ids else []
                names.append(",".join(x for x, _ in matched))
                kinds.append(max((k for _, k in matched), key=KINDS.index, default=None))
                known.append(",".join(ids))
                n.append(len(ids))
                said.append(";".join(expressions))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(known, pa.string()), pa.array(n, pa.int64()), pa.array(said, pa.string())],
                names=["doc_id", "licences", "kind", "sentences", "n_sentences", "expressions"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(found, "doc_id bigint, licences string, kind string, sentences string, n_sentences bigint, expressions string")
