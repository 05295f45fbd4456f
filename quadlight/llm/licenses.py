"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than a-z and 0-9 as one space) and cut into pieces. Known
licence sentences are one or more whole pieces in a row, so they may be wrapped over lines and hold ; or : inside; of
those that begin at a piece, the longest counts. The identifiers found, in order, are matched against ordered licence
rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import ascii_lower

#: Licence sentences by identifier, as they stand in public licence texts and notices.
SENTENCES = {
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "mit-name-3": "This project is licensed under the terms of the MIT license.",
    "mit-title": "MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-notice-full": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-name-2": "Licensed under the GNU General Public License, version 3.",
    "gpl2-name": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd2-name": "Licensed under the BSD 2-Clause License.",
    "bsd3-name": "Licensed under the BSD 3-Clause License.",
    "mpl-name": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "cc-by-name": "Licensed under CC BY 4.0.",
    "cc-by-sa-name": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-name": "Licensed under CC BY-ND 4.0.",
    "cc0-name": "Licensed under CC0 1.0.",
    "reserved": "All rights reserved.",
    "isc-name": "Licensed under the ISC License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-old": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero-bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-name": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-name": "Licensed under the GNU Affero General Public License, version 3.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2-name": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "boost-name": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense-grant": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic2-name": "Licensed under the Artistic License 2.0.",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc-by-title": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-title": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-title": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-title": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}
#: Licences as sequences of sentences that follow each other among the known ones; longer rules win.
RULES = {
    "0BSD": [["zero-bsd-grant"]],
    "AGPL-3.0": [["agpl3-name"], ["agpl3-grant"], ["agpl3-grant", "gpl-hope"]],
    "Apache-2.0": [["apache-name"], ["apache-notice"], ["apache-notice-full"], ["apache-notice", "apache-copy"], ["apache-notice-full", "apache-copy"]],
    "Artistic-2.0": [["artistic2-name"]],
    "BSD-2-Clause": [["bsd2-name"], ["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd3-name"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]],
    "BSL-1.0": [["boost-name"], ["boost-grant"]],
    "CC-BY-4.0": [["cc-by-name"], ["cc-by-title"]],
    "CC-BY-NC-4.0": [["cc-by-nc-name"], ["cc-by-nc-title"]],
    "CC-BY-ND-4.0": [["cc-by-nd-name"], ["cc-by-nd-title"]],
    "CC-BY-SA-4.0": [["cc-by-sa-name"], ["cc-by-sa-title"]],
    "CC0-1.0": [["cc0-name"], ["cc0-dedication"]],
    "EPL-2.0": [["epl2-name"]],
    "GPL-2.0": [["gpl2-name"], ["gpl2-grant"], ["gpl2-grant", "gpl-hope"]],
    "GPL-3.0": [["gpl3-name"], ["gpl3-name-2"], ["gpl-grant"], ["gpl-grant", "gpl-hope"]],
    "ISC": [["isc-name"], ["isc-grant"], ["isc-grant-old"]],
    "LGPL-2.1": [["lgpl21-grant"]],
    "LGPL-3.0": [["lgpl3-name"], ["lgpl3-grant"], ["lgpl3-grant", "gpl-hope"]],
    "MIT": [["mit-name"], ["mit-name-2"], ["mit-name-3"], ["mit-title"], ["mit-title-2"], ["mit-title", "mit-grant", "mit-keep"], ["mit-title-2", "mit-grant", "mit-keep"], ["mit-grant", "mit-keep"], ["mit-grant"]],
    "MPL-2.0": [["mpl-name"], ["mpl-notice"], ["mpl-notice", "mpl-copy"]],
    "Unlicense": [["unlicense-grant"], ["unlicense-grant", "unlicense-use"]],
    "Zlib": [["zlib-grant"]],
    "all-rights-reserved": [["reserved"]],
}
#: Between the pieces of a text.
CUT = "|"


def normal(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(text: Column) -> Column:
    """The normalised pieces of a text with ``CUT`` around each: it is cut after . ! ? ; : before white space, and at
    line ends."""
    marked = F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n")
    spaced = F.regexp_replace(ascii_lower(marked), "[^a-z0-9\n\r]+", " ")
    return F.concat(F.lit(CUT), F.regexp_replace(F.trim(spaced), "[ \n\r]*[\n\r][ \n\r]*", CUT), F.lit(CUT))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentence_ids, licenses, n_licenses) for each row.

    ``sentence_ids``: identifiers of the known sentences in order, with a space between. ``licenses``: the licences in
    order of their first match, a longer rule before any that it holds, with a space between. Both are empty for null,
    empty and other texts without one. Repeated rows give equal results; an empty table gives an empty result; extra
    columns are ignored.
    """
    by_sentence = {normal(s): k for k, s in SENTENCES.items()}
    known = F.create_map(*[F.lit(x) for pair in by_sentence.items() for x in pair])
    text = F.col(text_col)
    longest = sorted(by_sentence, key=lambda k: (-len(k), k))
    whole = rf"(?<=\|)({'|'.join(k.replace(' ', '[ |]') for k in longest)})(?=\|)"
    found = F.regexp_extract_all(pieces(text), F.lit(whole), F.lit(1))
    ids = F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit(CUT), F.lit(" "))))
    ids = F.coalesce(F.array_join(ids, " "), F.lit(""))
    out = docs.select(F.col(id_col), ids.alias("sentence_ids"))
    # Every rule that matches is cut out of the sequence and leaves its licence, so rules that it holds do not match again.
    spaced = F.concat(F.lit(" "), F.replace(F.col("sentence_ids"), F.lit(" "), F.lit("  ")), F.lit(" "))
    rules = sorted(((len(r), name, r) for name, all_rules in RULES.items() for r in all_rules), key=lambda x: (-x[0], x[1], x[2]))
    marked = reduce(lambda c, r: F.replace(c, F.lit(f" {'  '.join(r[2])} "), F.lit(f" ={r[1]} ")), rules, spaced)
    names = F.array_distinct(F.transform(F.filter(F.split(marked, " +", -1), lambda x: x.startswith("=")), lambda x: F.substring(x, F.lit(2), F.length(x))))
    out = out.withColumn("_names", F.when(F.col("sentence_ids") != "", names).otherwise(F.array().cast("array<string>")))
    return out.select(id_col, "sentence_ids", F.array_join("_names", " ").alias("licenses"), F.size("_names").cast("long").alias("n_licenses"))


def scan_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    by_sentence = {normal(s): k for k, s in SENTENCES.items()}
    rules = sorted(((len(r), name, r) for name, all_rules in RULES.items() for r in all_rules), key=lambda x: (-x[0], x[1], x[2]))
    marked = reduce(lambda c, r: f"replace({c}, ' {'  '.join(r[2])} ', ' ={r[1]} ')", rules, "' ' || replace(sentence_ids, ' ', '  ') || ' '")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = rf"regexp_replace({lower}, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g')"
    spaced = f"trim(regexp_replace({cut}, '[^a-z0-9\n\r]+', ' ', 'g'))"
    # Every piece has bounds of its own, so that sentences side by side can both be found without looking around.
    pieces = rf"'|' || regexp_replace({spaced}, '[ \n\r]*[\n\r][ \n\r]*', '||', 'g') || '|'"
    longest = sorted(by_sentence, key=lambda k: (-len(k), k))
    whole = rf"\|({'|'.join(k.replace(' ', '( |[|][|])') for k in longest)})\|".replace("( |[|][|])", "(?: |[|][|])")
    known = f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in by_sentence.items())}}}"
    return f"""
WITH found AS (SELECT doc_id, regexp_extract_all({pieces}, '{whole}', 1) AS f FROM documents),
known AS (SELECT {known} AS m),
seqs AS (SELECT doc_id, array_to_string(list_transform(f, lambda x: element_at(m, replace(x, '||', ' '))[1]), ' ') AS sentence_ids FROM found, known),
ids AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids FROM seqs),
marked AS (SELECT doc_id, sentence_ids, list_filter(string_split({marked}, ' '), lambda x: starts_with(x, '=')) AS m FROM ids),
firsts AS (SELECT doc_id, sentence_ids, list_transform(list_filter(m, lambda x, i: list_position(m, x) = i), lambda x: x[2:]) AS names FROM marked)
SELECT doc_id, sentence_ids, array_to_string(names, ' ') AS licenses, CAST(len(names) AS BIGINT) AS n_licenses FROM firsts"""
