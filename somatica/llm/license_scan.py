"""License scans: sentences are mapped to known license sentences, whose order is matched against rules."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somatica.llm.common import slices

# Names under which licenses are cited, and their identifiers.
NAMES = {
    "MIT": ("MIT License", "MIT license", "Expat License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0-only"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License version 3", "GNU GPL v3", "GPLv3", "GPL-3.0-only"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3", "LGPLv3", "LGPL-3.0-only"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License version 3", "AGPLv3", "AGPL-3.0-only"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
}
# Sentences that put a text under a named license.
NOTICES = (
    "Licensed under {the}{name}.",
    "Licensed under the terms of {the}{name}.",
    "Released under {the}{name}.",
    "Distributed under {the}{name}.",
    "Available under {the}{name}.",
    "This work is licensed under {the}{name}.",
    "This project is licensed under {the}{name}.",
    "This software is licensed under {the}{name}.",
    "This code is released under {the}{name}.",
    "SPDX-License-Identifier: {name}",
    "License: {name}",
)
# Sentences of license texts and headers.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "lgpl2-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-only-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "wtfpl-grant": "You just DO WHAT THE FUCK YOU WANT TO.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "apache-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-redistribution": "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    "gpl2-preamble": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl2-copying": "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program.",
    "gpl3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl3-copying": "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program.",
    "agpl3-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "lgpl2-preamble": "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "lgpl3-terms": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mpl-contributor": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
    "mpl-source": "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
    "epl2-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "cc0-purpose": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
}
#: Opening sentence of the texts of one family, which differ by their name only.
SENTENCES |= {
    f"text:{name}": f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {shown} Public License ("Public License").'
    for name, shown in ((k, v[1].removesuffix(" License")) for k, v in NAMES.items() if k.startswith("CC-BY"))
}
#: License and the sentence identifiers that must follow each other (other sentences may lie between). Of the rules of a kind of
#: text, those with more sentences come first and use theirs up, so that a three-clause text is not also a two-clause one.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("LGPL-2.1-or-later", ("lgpl2-grant",)),
    ("LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("GPL-2.0-only", ("gpl2-only-grant",)),
    ("MPL-2.0", ("mpl-grant",)),
    ("EPL-2.0", ("epl-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Unlicense", ("unlicense-grant", "unlicense-use")),
    ("Unlicense", ("unlicense-grant",)),
    ("Apache-2.0", ("apache-copyright", "apache-redistribution")),
    ("GPL-2.0-only", ("gpl2-preamble", "gpl2-copying")),
    ("AGPL-3.0-only", ("agpl3-preamble", "gpl3-copying")),
    ("GPL-3.0-only", ("gpl3-preamble", "gpl3-copying")),
    ("LGPL-2.1-only", ("lgpl2-preamble",)),
    ("LGPL-3.0-only", ("lgpl3-terms",)),
    ("MPL-2.0", ("mpl-contributor", "mpl-source")),
    ("EPL-2.0", ("epl2-terms",)),
    ("CC0-1.0", ("cc0-purpose",)),
    *((key.removeprefix("text:"), (key,)) for key in SENTENCES if key.startswith("text:")),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
    *((name, (f"named:{name}",)) for name in NAMES),
)

#: Words: letters and digits, with points inside numbers. Everything else parts them.
_WORD = re.compile(r"[0-9a-z]+(?:\.(?=[0-9])[0-9a-z]+)*")
#: Signs between two words behind which a sentence may begin, or before which one may end.
_SIGN = re.compile(r"[.:;!?\n\r()\[\]{}<>*#|/\u2022\u3002\uff01\uff1f]")
def sentence_words(sentence: str) -> list[str]:
    """A sentence in normal form: its words in lower case, without marks, brackets and line breaks."""
    return _WORD.findall(sentence.lower())


@dataclass(frozen=True)
class Scanner:
    """``tree``: the known sentences word by word; the identifier stands at the end of each, under the empty word. ``begins``
    finds the first two words of any of them."""

    tree: dict
    begins: re.Pattern

    @classmethod
    def of(cls, known: dict[str, str]) -> Scanner:
        """``known``: sentence (two words at least) to identifier."""
        tree: dict = {}
        for sentence, key in known.items():
            node = tree
            for word in sentence_words(sentence):
                node = node.setdefault(word, {})
            node[""] = key
        firsts = "|".join(f"{re.escape(one)}[^0-9a-z]+(?:{'|'.join(map(re.escape, sorted(two, reverse=True)))})" for one, two in sorted(tree.items()))
        return cls(tree, re.compile(f"(?<![0-9a-z])(?:{firsts})(?![0-9a-z])"))

    @classmethod
    def default(cls) -> Scanner:
        notices = {notice.format(name=s, the=the): f"named:{name}" for name, shown in NAMES.items() for notice in NOTICES for s in shown for the in ("the ", "")}
        return cls.of(notices | {sentence: key for key, sentence in SENTENCES.items()})

    def identifiers(self, text: str) -> list[str]:
        """Identifiers of the known sentences of ``text``, in order.

        A known sentence is found where its words follow each other from the beginning of a sentence (of a line, behind a
        sign) to the end of one, whatever stands between the words: it may be broken over lines anywhere. Of two that
        begin alike the longer counts.
        """
        low, out, at = text.lower(), [], 0
        while begin := self.begins.search(low, at):
            first = begin.start()
            at = first + 1
            before = first
            while before and not (low[before - 1].isascii() and low[before - 1].isalnum()):
                before -= 1
            if before and not _SIGN.search(low, before, first):
                continue
            node, found = self.tree, None
            for m in _WORD.finditer(low, first):
                node = node.get(m.group())
                if node is None:
                    break
                if "" in node:
                    after = _WORD.search(low, m.end())
                    if after is None or _SIGN.search(low, m.end(), after.start()):
                        found, at = node[""], m.end()
            if found:
                out.append(found)
        return out

    def licenses(self, identifiers: list[str]) -> list[str]:
        """Licenses of the rules that match, in order of their first sentence.

        A rule takes its sentences as they come: each goes to the oldest match that waits for it. What whole matches took is not
        there for later rules. One pass over the places of a rule's sentences, however many matches there are.
        """
        places: dict[str, list[int]] = {}
        for k, s in enumerate(identifiers):
            places.setdefault(s, []).append(k)
        found = []
        for name, sequence in RULES:
            waiting: list[deque] = [deque() for _ in sequence]
            taken: dict[str, set[int]] = {s: set() for s in sequence}
            for k, at in sorted((k, at) for at, s in enumerate(sequence) for k in places.get(s, ())) if all(s in places for s in sequence) else ():
                if at and not waiting[at]:
                    continue
                picked = (*waiting[at].popleft(), k) if at else (k,)
                if len(picked) < len(sequence):
                    waiting[at + 1].append(picked)
                    continue
                found.append((picked[0], name))
                for s, place in zip(sequence, picked, strict=True):
                    taken[s].add(place)
            for s, gone in taken.items():
                if gone:
                    places[s] = [k for k in places[s] if k not in gone]
        return list(dict.fromkeys(name for _, name in sorted(found)))


_KIND = T.StructType([T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("licenses", T.ArrayType(T.StringType()))])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licenses that the whole text of each document names or quotes.

    Returns doc_id, sentences (identifiers of the known license sentences, in order) and licenses (identifiers of the
    matching rules, in order of their first sentence, each once); both empty where nothing is known. Null and empty texts
    have none. Repeated rows and null ids come back as they came; an empty table gives no rows; other columns are
    ignored. One pass over the rows, without a shuffle.
    """
    scanner = Scanner.default()

    @F.arrow_udf(_KIND)
    def scan(texts: pa.Array) -> pa.Array:
        sentences = [scanner.identifiers(t) if t else [] for _, _, values in slices(texts) for t in values]
        licenses = [scanner.licenses(s) if s else [] for s in sentences]
        return pa.StructArray.from_arrays([pa.array(sentences, pa.list_(pa.string())), pa.array(licenses, pa.list_(pa.string()))], ["sentences", "licenses"])

    return docs.select("doc_id", scan(F.col("text")).alias("s")).select("doc_id", "s.sentences", "s.licenses")
