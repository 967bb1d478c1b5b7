"""Signature rules of licenses: what is looked for, in order, with keyword and priority.

A rule's pattern is matched against a text's words, lower-case and joined by single blanks; it
begins and ends with a word. Each license has up to five kinds of rule, by rising priority: its
name alone, its SPDX identifier or address, a notice that names it, and sentences of its text.
"""

from __future__ import annotations

from typing import NamedTuple

PHRASE, NAME, IDENTIFIER, NOTICE, TEXT = 1, 2, 3, 4, 5
LEVELS = (PHRASE, NAME, IDENTIFIER, NOTICE, TEXT)

#: What a notice says before a license's name.
UNDER = (r"(?:(?:dual |re |sub )?licen[sc]ed|released|distributed|redistributed|published|provided|"
         r"available|made available|covered|governed|offered|shared)"
         r"(?: for use)? (?:under|by|according to|subject to)(?: the)?(?: terms)?(?: and conditions)?"
         r"(?: of)?(?: the| an?)?")


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: The four phrases that are counted wherever they stand.
BASE = (
    Rule("gpl", PHRASE, "gnu general public license", "gnu general public license"),
    Rule("apache", PHRASE, "apache license", "apache license"),
    Rule("cc-by", PHRASE, "cc by", "cc by"),
    Rule("mit", PHRASE, "mit license", "mit license"),
)

LATER = r"(?: or(?: at your option)?(?: any)? later(?: version)?)?"

#: label; keyword and pattern of its names; keyword and pattern of identifiers and addresses.
NAMED = (
    ("gpl-1.0", "general public licen", rf"gnu general public licen[sc]e version 1(?: 0)?\b{LATER}", "gpl", r"gpl(?: v)? ?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "general public licen", rf"(?:gnu )?general public licen[sc]e version 2(?: 0)?\b{LATER}", "gpl", r"gpl ?v? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "general public licen", rf"(?:gnu )?general public licen[sc]e version 3(?: 0)?\b{LATER}", "gpl", r"gpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "general public licen", rf"(?:gnu )?library general public licen[sc]e(?: version 2(?: 0)?)?{LATER}", "lgpl", r"lgpl ?v? ?2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public licen", rf"(?:gnu )?lesser general public licen[sc]e version 2 1{LATER}", "lgpl", r"lgpl ?v? ?2 1(?: only| or later)?"),
    ("lgpl-3.0", "general public licen", rf"(?:gnu )?lesser general public licen[sc]e version 3(?: 0)?{LATER}", "lgpl", r"lgpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "general public licen", r"(?:gnu )?lesser general public licen[sc]e", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl-1.0", "general public licen", r"affero general public licen[sc]e(?: version)? 1(?: 0)?", "agpl", r"agpl ?v? ?1(?: 0)?"),
    ("agpl-3.0", "general public licen", rf"(?:gnu )?affero general public licen[sc]e(?: version 3(?: 0)?)?{LATER}", "agpl", r"agpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("gfdl", "free documentation licen", rf"(?:gnu )?free documentation licen[sc]e(?: version 1 [123])?{LATER}", "gfdl", r"gfdl(?: 1 [123])?(?: only| or later)?"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[sc]e version 1 0", "apache", r"apache(?: licen[sc]e)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e version 1 1", "apache", r"apache(?: licen[sc]e)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e version 2(?: 0)?", "apache", r"(?:apache(?: licen[sc]e)? ?v? ?2(?: 0)?|apache org licen[sc]es licen[sc]e 2 0)"),
    ("mit", "licen", r"(?:mit|expat)(?: x11| expat)? licen[sc]e", "mit", r"(?:spdx licen[sc]e identifier mit|opensource org licen[sc]es mit(?: licen[sc]e php)?)"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", "mit 0", r"mit 0"),
    ("x11", "x11 licen", r"x11 licen[sc]e", "identifier x11", r"spdx licen[sc]e identifier x11"),
    ("bsd-1-clause", "bsd", r"bsd (?:1|one) clause(?: licen[sc]e)?", "bsd", r"(?:1|one) clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd licen[sc]e", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[sc]e", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|old) bsd licen[sc]e", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:zero clause|free public) bsd(?: licen[sc]e)?", "0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", "bsd", r"opensource org licen[sc]es bsd licen[sc]e(?: php)?"),
    ("isc", "isc licen", r"isc licen[sc]e", "identifier isc", r"spdx licen[sc]e identifier isc"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e version 1 0", "mpl", r"mpl ?v? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e version 1 1", "mpl", r"(?:mpl ?v? ?1 1|mozilla org mpl mpl 1 1)"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mpl", r"(?:mpl ?v? ?2(?: 0)?|mozilla org mpl 2 0)"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", "epl", r"(?:epl ?v? ?1 ?0?|eclipse org legal epl v10)"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", "epl", r"(?:epl ?v? ?2 ?0?|eclipse org legal epl 2 0)"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: version 1 0)?", "edl", r"edl v? ?1 0"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: version)?(?: 1 0)?", "cpl", r"cpl v? ?1 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: version)?(?: 1 0)?", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1.1", "common development", r"common development and distribution licen[sc]e version 1 1", "cddl", r"cddl 1 1"),
    ("eupl-1.1", "european union", r"european union public licen[sc]e(?: version| v)? ?1 1", "eupl", r"eupl ?v? ?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?: version| v)? ?1 2", "eupl", r"eupl ?v? ?1 2"),
    ("cecill-2.0", "cecill", r"cecill(?: free software)? licen[sc]e(?: agreement)?(?: version 2 0)?", "cecill", r"cecill 2 0"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[sc]e(?: agreement)? version 2 1", "cecill", r"cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b(?: free software)? licen[sc]e(?: agreement)?", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c(?: free software)? licen[sc]e(?: agreement)?", "cecill", r"cecill c"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version)? 1 0", "artistic", r"artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version)? 2 0", "artistic", r"(?:artistic 2 0|perlfoundation org artistic licen[sc]e 2 0)"),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic", r"opensource org licen[sc]es artistic licen[sc]e(?: php)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "identifier zlib", r"spdx licen[sc]e identifier zlib"),
    ("libpng", "licen", r"(?:png reference library|libpng) licen[sc]e(?: version 2)?", "libpng", r"libpng 2 0"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "1 0", r"(?:bsl 1 0|boost org licen[sc]e 1 0(?: txt)?)"),
    ("bsl-1.1", "business source", r"business source licen[sc]e(?: version)?(?: 1 1)?", "busl", r"busl 1 1"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: version)?(?: 1)?", "sspl", r"sspl(?: 1 0)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version)?(?: 2 0)?", "elastic", r"elastic 2 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "do what the", r"do what the f\w+ you want to public licen[sc]e", "wtfpl", r"wtfpl(?: v? ?2)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "public domain", r"(?:dedicated to|placed in(?:to)?|released into|in) the public domain", "publicdomain", r"creativecommons org (?:licen[sc]es )?publicdomain(?: mark 1 0)?"),
    ("cc-by-1.0", "attribution", r"creative commons attribution(?: licen[sc]e)? 1 0(?: generic)?", "by 1 0", r"(?:cc by 1 0|creativecommons org licen[sc]es by 1 0)"),
    ("cc-by-2.0", "attribution", r"creative commons attribution(?: licen[sc]e)? 2 0(?: generic)?", "by 2 0", r"(?:cc by 2 0|creativecommons org licen[sc]es by 2 0)"),
    ("cc-by-2.5", "attribution", r"creative commons attribution(?: licen[sc]e)? 2 5(?: generic)?", "by 2 5", r"(?:cc by 2 5|creativecommons org licen[sc]es by 2 5)"),
    ("cc-by-3.0", "attribution", r"creative commons attribution(?: licen[sc]e)? 3 0(?: unported)?", "by 3 0", r"(?:cc by 3 0|creativecommons org licen[sc]es by 3 0)"),
    ("cc-by-4.0", "attribution", r"creative commons attribution(?: licen[sc]e)? 4 0(?: international)?", "by 4 0", r"(?:cc by 4 0|creativecommons org licen[sc]es by 4 0)"),
    ("cc-by-sa-2.0", "attribution share", r"attribution share ?alike 2 0(?: generic)?", "by sa 2 0", r"(?:cc by sa 2 0|creativecommons org licen[sc]es by sa 2 0)"),
    ("cc-by-sa-2.5", "attribution share", r"attribution share ?alike 2 5(?: generic)?", "by sa 2 5", r"(?:cc by sa 2 5|creativecommons org licen[sc]es by sa 2 5)"),
    ("cc-by-sa-3.0", "attribution share", r"attribution share ?alike 3 0(?: unported)?", "by sa 3 0", r"(?:cc by sa 3 0|creativecommons org licen[sc]es by sa 3 0)"),
    ("cc-by-sa-4.0", "attribution share", r"attribution share ?alike 4 0(?: international)?", "by sa 4 0", r"(?:cc by sa 4 0|creativecommons org licen[sc]es by sa 4 0)"),
    ("cc-by-nc-3.0", "attribution non", r"attribution non ?commercial 3 0(?: unported)?", "by nc 3 0", r"(?:cc by nc 3 0|creativecommons org licen[sc]es by nc 3 0)"),
    ("cc-by-nc-4.0", "attribution non", r"attribution non ?commercial 4 0(?: international)?", "by nc 4 0", r"(?:cc by nc 4 0|creativecommons org licen[sc]es by nc 4 0)"),
    ("cc-by-nc-sa-3.0", "attribution non", r"attribution non ?commercial share ?alike 3 0(?: unported)?", "by nc sa 3 0", r"(?:cc by nc sa 3 0|creativecommons org licen[sc]es by nc sa 3 0)"),
    ("cc-by-nc-sa-4.0", "attribution non", r"attribution non ?commercial share ?alike 4 0(?: international)?", "by nc sa 4 0", r"(?:cc by nc sa 4 0|creativecommons org licen[sc]es by nc sa 4 0)"),
    ("cc-by-nd-4.0", "attribution no", r"attribution no ?deriv(?:s|atives) 4 0(?: international)?", "by nd 4 0", r"(?:cc by nd 4 0|creativecommons org licen[sc]es by nd 4 0)"),
    ("cc-by-nc-nd-3.0", "attribution non", r"attribution non ?commercial no ?deriv(?:s|atives) 3 0(?: unported)?", "by nc nd 3 0", r"(?:cc by nc nd 3 0|creativecommons org licen[sc]es by nc nd 3 0)"),
    ("cc-by-nc-nd-4.0", "attribution non", r"attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?", "by nc nd 4 0", r"(?:cc by nc nd 4 0|creativecommons org licen[sc]es by nc nd 4 0)"),
    ("cc-by-nc", "creative commons", r"creative commons(?: attribution)? non ?commercial(?: licen[sc]e)?", "by nc", r"cc by nc"),
    ("cc-by-sa", "creative commons", r"creative commons(?: attribution)? share ?alike(?: licen[sc]e)?", "by sa", r"cc by sa"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?", "ofl", r"(?:ofl 1 1|scripts sil org ofl)"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database licen[sc]e(?: v? ?1 0)?", "odbl", r"(?:odbl(?: 1 0)?|opendatacommons org licen[sc]es odbl)"),
    ("odc-by-1.0", "open data", r"open data commons attribution licen[sc]e(?: v? ?1 0)?", "by", r"(?:odc by(?: 1 0)?|opendatacommons org licen[sc]es by)"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[sc]e(?: v? ?1 0)?", "pddl", r"(?:pddl(?: 1 0)?|opendatacommons org licen[sc]es pddl)"),
    ("psf-2.0", "licen", r"(?:python software foundation|psf) licen[sc]e(?: agreement)?(?: version 2)?", "psf", r"psf 2 0"),
    ("python-2.0", "python", r"python licen[sc]e(?: version)?(?: 2 0)?", "identifier python", r"spdx licen[sc]e identifier python 2 0"),
    ("ruby", "ruby", r"ruby(?: s)? licen[sc]e", "ruby", r"ruby lang org en about licen[sc]e(?: txt)?"),
    ("php-3.0", "php", r"php licen[sc]e(?: version)? 3 0", "php", r"php net licen[sc]e 3 0(?: txt)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)? 3 01", "php", r"php net licen[sc]e 3 01(?: txt)?"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl", r"openssl org source licen[sc]e(?: html)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "identifier ncsa", r"spdx licen[sc]e identifier ncsa"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", r"postgresql org about licen[sc]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", "w3 org", r"w3 org consortium legal 20\d\d copyright software"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl", r"ms rl"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: version| v)?(?: 3 0)?", "osl", r"osl 3 0"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: version| v)?(?: 3 0)?", "afl", r"afl 3 0"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v? ?1 0)?", "upl", r"upl 1 0"),
    ("blueoak-1.0", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?", "blueoak", r"blueoak 1 0 0"),
    ("mulan-psl-2.0", "mulan", r"mulan permissive software licen[sc]e(?: version| v)? ?2", "mulan", r"mulanpsl 2 0"),
    ("lppl-1.3c", "latex", r"latex project public licen[sc]e(?: version| v)?(?: 1 3c?)?", "lppl", r"(?:lppl(?: 1 3c)?|latex project org lppl(?: txt)?)"),
    ("vim", "vim licen", r"vim licen[sc]e", "identifier vim", r"spdx licen[sc]e identifier vim"),
    ("curl", "curl licen", r"curl licen[sc]e", "curl", r"curl se docs copyright html"),
    ("beerware", "licen", r"beer ?ware licen[sc]e", "identifier beerware", r"spdx licen[sc]e identifier beerware"),
    ("json", "json", r"json licen[sc]e", "json", r"json org licen[sc]e html"),
    ("unicode-dfs", "unicode", r"unicode licen[sc]e(?: agreement)?(?: v3)?", "unicode", r"(?:unicode dfs 201[56]|unicode org (?:copyright|licen[sc]e)(?: html| txt)?)"),
    ("qpl-1.0", "q public", r"q public licen[sc]e(?: version)?(?: 1 0)?", "qpl", r"qpl 1 0"),
    ("sleepycat", "sleepycat licen", r"sleepycat licen[sc]e", "identifier sleepycat", r"spdx licen[sc]e identifier sleepycat"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 1)?", "zpl", r"zpl 2 1"),
    ("naist", "naist", r"naist licen[sc]e", "naist", r"naist 2003"),
    ("proprietary", "all rights", r"all rights reserved", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
)

#: label, keyword, pattern: sentences of the licenses themselves and of their standard notices.
SENTENCES = (
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "general public licen", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|file)"),
    ("gpl-2.0", "general public licen", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", "general public licen", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "general public licen", r"you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:program|library|file)"),
    ("agpl-3.0", "general public licen", r"you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|library|file)"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("apache-2.0", "apache", r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "basis", r"distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "disclaimed", r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e 2 0"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-1.0", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the", r"you just do what the f\w+ you want to"),
    ("cc0-1.0", "neighboring", r"to the extent possible under law (?:\w+ ){1,12}waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", r"this (?:work|file|software|code) (?:is|has been) (?:in|placed in|released into|dedicated to) the public domain"),
    ("cc-by", "creative commons", r"this work is licen[sc]ed under (?:a|the) creative commons attribution(?: \d 0| 2 5)?(?: \w+)? licen[sc]e"),
    ("cc-by-sa", "creative commons", r"this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike(?: \d 0| 2 5)?(?: \w+)? licen[sc]e"),
    ("cc-by-nc", "creative commons", r"this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial(?: \d 0| 2 5)?(?: \w+)? licen[sc]e"),
    ("ofl-1.1", "font", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "good", r"the software shall be used for good not evil"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php licen[sc]e"),
    ("php-3.0", "php", r"this source file is subject to version 3 0 of the php licen[sc]e"),
    ("artistic", "perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("proprietary", "prohibited", r"unauthorized (?:copying|reproduction|distribution)(?: \w+){0,8} is strictly prohibited"),
)

#: Notices that name a family but no version.
FAMILIES = (
    ("gpl", "gpl", r"(?:gnu )?gpl"), ("gpl", "general public licen", r"(?:gnu )?general public licen[sc]e"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"), ("cc-by", "cc by", r"cc by"),
    ("cc-by", "creative commons", r"creative commons attribution licen[sc]e"),
    ("cc", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: licen[sc]e)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"), ("epl", "eclipse", r"eclipse public licen[sc]e"),
)


def all_rules() -> tuple[Rule, ...]:
    """Every rule in order: equal detections of one priority go to the earlier rule."""
    out = list(BASE)
    for label, word, name, key, identifier in NAMED:
        out.append(Rule(label, NAME, word, name))
        out.append(Rule(label, IDENTIFIER, key, identifier))
        out.append(Rule(label, NOTICE, word, f"{UNDER} {name}"))
        out.append(Rule(label, NOTICE, key, f"{UNDER} {identifier}"))
    out += [Rule(label, NOTICE, word, f"{UNDER} {name}") for label, word, name in FAMILIES]
    out += [Rule(label, TEXT, word, sentence) for label, word, sentence in SENTENCES]
    return tuple(out)
