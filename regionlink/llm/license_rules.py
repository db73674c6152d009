"""The ordered signature rules of the license scan.

Patterns run over normalised text: words of letters and digits in lower case, one blank between two words. A pattern matches
whole words. Each rule names a keyword, so that a text without it never meets the pattern. Every match of a pattern contains
the keyword of its rule; where one word can't do that, the pattern stands in one rule for each of several.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: A smaller priority is stronger: license texts, then notices and tags, then names, then loose mentions.
TEXT, NOTICE, NAME, LOOSE = 1, 2, 3, 4
CONFIDENCE = {TEXT: 0.99, NOTICE: 0.95, NAME: 0.8, LOOSE: 0.5}
#: Every keyword contains one of these.
STEMS = (
    "licen", "general public", "copyright", "spdx", "permi", "public domain", "creative commons", "cc by", "cc0", "cc zero",
    "rights reserved", "warrant", "redistribut", "gpl", "unlicen", "mit no attribution", "apache", "bsd", "free public",
    "mozilla public", "eclipse public", "eclipse distribution", "cddl", "common development", "common public", "ibm public",
    "european union public", "artistic", "same terms as perl", "python", "psf", "php", "zope public", "open software",
    "academic free", "business source", "server side public", "elastic", "polyform", "open font", "open data", "cecill",
    "mulan", "openldap public", "nasa open source", "apple public source", "contributors may be used", "advertising materials", "plainly marked",
)

_NOTICE = "(?:licen[sc]ed|released|distributed|published|provided|available|made available|covered|governed|redistributed|offered|shared|use is granted) (?:under|by|subject to|pursuant to|in accordance with)(?: either)?(?: the)?(?: terms(?: and conditions)? of)?(?: the)? "
_OF = "(?: licen[sc]e)?"
_V = "(?: licen[sc]e)?(?: version| ver| v)?(?: v| )"

#: label, name pattern, words of the SPDX tag (none: the license has no tag), keywords of name and notice: every match has one of them.
LICENSES = (
    ("mit", "(?:mit|expat) licen[sc]e", "mit", "licen"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?", "mit 0", "mit no attribution"),
    ("x11", "(?:x11|mit x11) licen[sc]e", "x11", "licen"),
    ("apache-2", "apache(?: software)?" + _V + "2(?: 0)?", "apache 2 0", "apache"),
    ("apache-1.1", "apache(?: software)?" + _V + "1 1", "apache 1 1", "apache"),
    ("apache-1", "apache(?: software)?" + _V + "1 0", "apache 1 0", "apache"),
    ("bsd-0", "(?:0 clause bsd|bsd 0 clause|zero clause bsd|free public licen[sc]e 1 0 0)" + _OF, "0bsd", "bsd|free public"),
    ("bsd-1", "(?:1 clause bsd|bsd 1 clause)" + _OF, "bsd 1 clause", "bsd"),
    ("bsd-2", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)" + _OF, "bsd 2 clause", "bsd"),
    ("bsd-2-patent", "(?:2 clause bsd|bsd 2 clause|bsd)(?: plus|\\+)? patent(?: licen[sc]e)?", "bsd 2 clause patent", "bsd"),
    ("bsd-3", "(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)" + _OF, "bsd 3 clause", "bsd"),
    ("bsd-3-clear", "(?:3 clause clear bsd|clear bsd|bsd 3 clause clear)" + _OF, "bsd 3 clause clear", "bsd"),
    ("bsd-4", "(?:4 clause bsd|bsd 4 clause|original bsd|old bsd)" + _OF, "bsd 4 clause", "bsd"),
    ("isc", "isc(?: software)? licen[sc]e", "isc", "licen"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", "licen"),
    ("libpng", "(?:libpng|png reference library) licen[sc]e", "libpng", "licen"),
    ("boost-1", "boost(?: software)? licen[sc]e(?: version)?(?: 1 0)?", "bsl 1 0", "licen"),
    ("gpl-1", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 1(?: 0)?(?: only)?", "gpl 1 0(?: only)?", "gpl|general public"),
    ("gpl-2", "(?:gnu )?(?:general public licen[sc]e|gpl|gplv2)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: only)?", "gpl 2 0(?: only)?", "gpl|general public"),
    ("gpl-2-or-later", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer)", "gpl 2 0 or later", "gpl|general public"),
    ("gpl-3", "(?:gnu )?(?:general public licen[sc]e|gpl|gplv3)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: only)?", "gpl 3 0(?: only)?", "gpl|general public"),
    ("gpl-3-or-later", "(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer)", "gpl 3 0 or later", "gpl|general public"),
    ("lgpl-2", "(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version| v)? 2(?: 0)?(?: only)?", "lgpl 2 0(?: only| or later)?", "gpl|general public"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2 1(?: only)?", "lgpl 2 1(?: only| or later)?", "gpl|general public"),
    ("lgpl-3", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: only)?", "lgpl 3 0(?: only| or later)?", "gpl|general public"),
    ("agpl-3", "(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: only)?", "agpl 3 0(?: only| or later)?", "gpl|general public"),
    ("gfdl-1.1", "(?:gnu )?free documentation licen[sc]e(?: version)? 1 1", "gfdl 1 1", "licen"),
    ("gfdl-1.2", "(?:gnu )?free documentation licen[sc]e(?: version)? 1 2", "gfdl 1 2", "licen"),
    ("gfdl-1.3", "(?:gnu )?free documentation licen[sc]e(?: version)? 1 3", "gfdl 1 3", "licen"),
    ("mpl-1", "mozilla public" + _V + "1(?: 0)?", "mpl 1 0", "mozilla public"),
    ("mpl-1.1", "mozilla public" + _V + "1 1", "mpl 1 1", "mozilla public"),
    ("mpl-2", "mozilla public" + _V + "2(?: 0)?", "mpl 2 0", "mozilla public"),
    ("epl-1", "eclipse public" + _V + "1(?: 0)?", "epl 1 0", "eclipse public"),
    ("epl-2", "eclipse public" + _V + "2(?: 0)?", "epl 2 0", "eclipse public"),
    ("edl-1", "eclipse distribution" + _V + "1(?: 0)?", "edl 1 0", "eclipse distribution"),
    ("cddl-1", "(?:common development and distribution|cddl)" + _V + "1(?: 0)?", "cddl 1 0", "cddl|common development"),
    ("cddl-1.1", "(?:common development and distribution|cddl)" + _V + "1 1", "cddl 1 1", "cddl|common development"),
    ("cpl-1", "common public" + _V + "1(?: 0)?", "cpl 1 0", "common public"),
    ("ipl-1", "ibm public" + _V + "1(?: 0)?", "ipl 1 0", "ibm public"),
    ("eupl-1.1", "european union public" + _V + "1 1", "eupl 1 1", "european union public"),
    ("eupl-1.2", "european union public" + _V + "1 2", "eupl 1 2", "european union public"),
    ("artistic-1", "artistic" + _V + "1(?: 0)?", "artistic 1 0", "artistic"),
    ("artistic-2", "artistic" + _V + "2(?: 0)?", "artistic 2 0", "artistic"),
    ("perl", "same terms as perl(?: 5)?(?: itself)?(?: licen[sc]e)?", "", "same terms as perl"),
    ("python-2", "(?:python software foundation|psf|python)" + _V + "2(?: 0)?", "python 2 0", "python|psf"),
    ("ruby", "ruby(?: s)? licen[sc]e", "ruby", "licen"),
    ("php-3.01", "php" + _V + "3 01", "php 3 01", "php"),
    ("php-3", "php" + _V + "3(?: 0)?", "php 3 0", "php"),
    ("openssl", "openssl licen[sc]e", "openssl", "licen"),
    ("ssleay", "ssleay licen[sc]e", "ssleay standalone", "licen"),
    ("curl", "curl licen[sc]e", "curl", "licen"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicen"),
    ("wtfpl", "(?:do what the fuck you want to public licen[sc]e|wtfpl licen[sc]e)", "wtfpl", "licen"),
    ("beerware", "beer ?ware licen[sc]e", "beerware", "licen"),
    ("postgresql", "postgresql licen[sc]e", "postgresql", "licen"),
    ("ncsa", "(?:university of illinois|ncsa)(?: ncsa)?(?: open source)? licen[sc]e", "ncsa", "licen"),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl", "licen"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl", "licen"),
    ("upl-1", "universal permissive" + _V + "1(?: 0)?", "upl 1 0", "permi"),
    ("vim", "vim licen[sc]e", "vim", "licen"),
    ("w3c", "w3c(?: software)?(?: notice and)? licen[sc]e", "w3c", "licen"),
    ("zpl-2.1", "zope public" + _V + "2 1", "zpl 2 1", "zope public"),
    ("zpl-2", "zope public" + _V + "2(?: 0)?", "zpl 2 0", "zope public"),
    ("osl-3", "open software" + _V + "3(?: 0)?", "osl 3 0", "open software"),
    ("afl-3", "academic free" + _V + "3(?: 0)?", "afl 3 0", "academic free"),
    ("bsl-1.1", "business source" + _V + "1 1", "busl 1 1", "business source"),
    ("sspl-1", "server side public" + _V + "1(?: 0)?", "sspl 1 0", "server side public"),
    ("elastic-2", "elastic" + _V + "2(?: 0)?", "elastic 2 0", "elastic"),
    ("polyform-nc", "polyform noncommercial" + _V + "1 0 0", "polyform noncommercial 1 0 0", "polyform"),
    ("ofl-1.1", "(?:sil )?open font" + _V + "1 1", "ofl 1 1", "open font"),
    ("odbl-1", "open (?:data commons open )?database" + _V + "1(?: 0)?", "odbl 1 0", "open data"),
    ("odc-by-1", "open data commons attribution" + _V + "1(?: 0)?", "odc by 1 0", "open data"),
    ("pddl-1", "(?:open data commons )?public domain dedication and" + _V + "1(?: 0)?", "pddl 1 0", "public domain"),
    ("cdla-permissive", "community data licen[sc]e agreement permissive", "cdla permissive [12] 0", "licen"),
    ("cdla-sharing", "community data licen[sc]e agreement sharing", "cdla sharing 1 0", "licen"),
    ("openrail", "(?:creativeml |bigscience |big code )?open ?rail m?(?: licen[sc]e)", "openrail", "licen"),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic 2 1", "licen"),
    ("cecill-2.1", "cecill" + _V + "2 1", "cecill 2 1", "cecill"),
    ("cecill-b", "cecill b" + _OF, "cecill b", "cecill"),
    ("mulan-2", "mulan(?: permissive software| psl)" + _V + "2", "mulanpsl 2 0", "mulan"),
    ("oldap-2.8", "openldap public" + _V + "2 8", "oldap 2 8", "openldap public"),
    ("intel", "intel open source licen[sc]e", "intel", "licen"),
    ("nasa-1.3", "nasa open source agreement(?: version)? 1 3", "nasa 1 3", "nasa open source"),
    ("lppl-1.3", "latex project public licen[sc]e(?: version| v)?(?: 1 3[ac]?)?", "lppl 1 3c", "licen"),
    ("apsl-2", "apple public source" + _V + "2(?: 0)?", "apsl 2 0", "apple public source"),
    ("qpl-1", "q public licen[sc]e(?: version)?(?: 1 0)?", "qpl 1 0", "licen"),
    ("rpl-1.5", "reciprocal public licen[sc]e(?: version)?(?: 1 5)?", "rpl 1 5", "licen"),
    ("npl-1.1", "netscape public licen[sc]e(?: version)?(?: 1 [01])?", "npl 1 1", "licen"),
    ("spl-1", "sun public licen[sc]e(?: version)?(?: 1 0)?", "spl 1 0", "licen"),
    ("sissl", "sun industry standards source licen[sc]e", "sissl", "licen"),
    ("watcom-1", "sybase open watcom public licen[sc]e", "watcom 1 0", "licen"),
    ("nokia", "nokia open source licen[sc]e", "nokia", "licen"),
    ("lpl-1.02", "lucent public licen[sc]e(?: version)?(?: 1 02)?", "lpl 1 02", "licen"),
    ("rpsl-1", "real ?networks public source licen[sc]e", "rpsl 1 0", "licen"),
    ("efl-2", "eiffel forum licen[sc]e(?: version)?(?: 2)?", "efl 2 0", "licen"),
    ("blueoak-1", "blue oak model licen[sc]e(?: 1 0 0)?", "blueoak 1 0 0", "licen"),
    ("json", "json licen[sc]e", "json", "licen"),
    ("tcl", "tcl(?: tk)? licen[sc]e", "tcl", "licen"),
    ("unicode", "unicode(?: data files and software)? licen[sc]e(?: v3| agreement)?", "unicode (?:dfs 2016|3 0)", "licen"),
    ("icu", "icu licen[sc]e", "icu", "licen"),
    ("ogl-3", "open government licen[sc]e(?: version| v)? ?3(?: 0)?", "ogl uk 3 0", "licen"),
    ("etalab-2", "(?:etalab )?licen[sc]e ouverte(?: open licen[sc]e)?(?: version)?(?: 2 0)?", "etalab 2 0", "licen"),
    ("llama", "llama [234](?: \\d)? community licen[sc]e", "", "licen"),
    ("rail", "responsible ai licen[sc]es?", "", "licen"),
)

#: Creative Commons by the words of their short and long names.
_CC = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)

#: label, pattern, keyword: phrases of the license texts themselves.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("bsd-2", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistribut"),
    ("bsd-3", "neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software", "contributors may be used"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "permission is hereby"),
    ("apache-2", "you may not use this file except in compliance with the licen[sc]e", "licen"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "licen"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "redistribut"),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e", "licen"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "redistribut"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "licen"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e", "licen"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "permission is granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e", "licen"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "licen"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "permitted to copy"),
    ("public-domain", "(?:released|placed|dedicated|put) (?:in ?to|to|in) the public domain", "public domain"),
    ("public-domain", "this work is in the public domain", "public domain"),
    ("python-2", "psf is making python available to licen[sc]ee on an as is basis", "licen"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement", "warrant"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribut"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribut"),
    ("bsd", "this software is provided by the (?:copyright holders|copyright owner|authors?|regents) and contributors as is and any express or implied warranties", "warrant"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "redistribut"),
    ("php-3", "redistribution and use in source and binary forms with or without modification is permitted provided that the following conditions are met", "redistribut"),
    ("oldap-2.8", "redistribution and use of this software and associated documentation software with or without modification are permitted provided that the following conditions are met", "redistribut"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "redistribut"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "permission to use"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "permission to use"),
    ("w3c", "permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted", "permission to copy"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose", "permission to use"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode data files|data files)", "permission is hereby"),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software", "permission is hereby"),
    ("ofl-1.1", "this licen[sc]e is copied below and is also available with a faq at", "licen"),
    ("upl-1", "permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "permission is hereby"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty", "permitted in any medium"),
    ("fsful", "the free software foundation gives unlimited permission to copy distribute and modify it", "permission to copy"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "artistic"),
    ("artistic-2", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "permitted to use"),
    ("polyform-nc", "any noncommercial purpose is a permitted purpose", "permitted purpose"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this licen[sc]e text", "licen"),
    ("ms-pl", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", "licen"),
    ("apache-2", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "apache software"),
    ("apache-2", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e to reproduce prepare derivative works of", "copyright"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software"),
    ("imagemagick", "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at(?: \\S+){0,4} imagemagick", "licen"),
    ("gpl", "see the gnu general public licen[sc]e for more details", "general public"),
    ("gpl", "the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom to share and change", "licen"),
    ("gpl-2-or-later", "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", "general public"),
    ("gpl-3-or-later", "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", "general public"),
    ("gpl-3", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", "general public"),
    ("lgpl", "this licen[sc]e the lesser general public licen[sc]e applies to some specially designated software packages", "general public"),
    ("lgpl-3", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e", "general public"),
    ("lgpl-2.1-or-later", "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version", "general public"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", "redistribut"),
    ("agpl-3", "specifically designed to ensure cooperation with the community in the case of network server software(?: \\S+){0,40}? licen[sc]es?", "licen"),
    ("gfdl", "the purpose of this licen[sc]e is to make a manual textbook or other functional and useful document free", "licen"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mozilla public"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common development"),
    ("cpl-1", "the accompanying program is provided under the terms of this common public licen[sc]e", "common public"),
    ("ipl-1", "the accompanying program is provided under the terms of this ibm public licen[sc]e", "ibm public"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public licen[sc]e", "eclipse public"),
    ("eupl", "licen[sc]ed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl", "licen"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[sc]e", "licen"),
    ("apsl", "modifications of original code as defined in and that are subject to the apple public source licen[sc]e", "licen"),
    ("python-2", "this licen[sc]e agreement is between the python software foundation(?: psf)? and the individual or organi[sz]ation", "python"),
    ("php-3", "this product includes php software freely available from", "php"),
    ("bsl-1.1", "the licen[sc]or hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[sc]ed work", "licen"),
    ("unlicense", "in jurisdictions that recogni[sz]e copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "public domain"),
    ("odbl-1", "the open database licen[sc]e odbl is a licen[sc]e agreement intended to allow users to freely share modify and use this database", "licen"),
    ("pddl-1", "the open data commons public domain dedication(?: and)? licen[sc]e is a document intended to allow you to freely share modify and use this work", "public domain"),
    ("cc0-1", "has dedicated the work to the public domain by waiving all of his or her rights", "public domain"),
    ("cc0-1", "has waived all copyright and related or neighbou?ring rights", "copyright"),
    ("cc0-1", "copyright and related rights waived via cc0", "cc0"),
    ("creative-commons", "the work as defined below is provided under the terms of this creative commons public licen[sc]e", "creative commons"),
    ("cc-by", "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made", "licen"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[sc]e as the original", "licen"),
    ("cecill", "this software is governed by the cecill(?: [abc])? licen[sc]e under french law and abiding by the rules of distribution of free software", "cecill"),
    ("mulan-2", "you can use this software according to the terms and conditions of the mulan psl v2", "mulan"),
    ("eula", "by (?:installing|downloading|copying|using)(?: \\S+){0,12}? you agree to be bound by the terms of this (?:end user )?licen[sc]e(?: agreement)?", "licen"),
    ("proprietary", "(?:strictly )?(?:confidential and )?proprietary unauthori[sz]ed (?:copying|use|distribution)(?: of this file)? (?:via any medium )?is (?:strictly )?prohibited(?: \\S+){0,6}? (?:copyright|licen[sc]e|permission)", "prohibited"),
)

#: label, pattern, keyword: mentions that say little.
LOOSES = (
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
    ("copyright", "copyright(?: c)? (?:19|20)\\d\\d(?: \\d{2,4})?", "copyright"),
    ("copyright", "copyright (?:by|holder|owner)", "copyright"),
    ("no-warranty", "without (?:any )?warranty of any kind", "warrant"),
    ("no-warranty", "without even the implied warranty of merchantability", "warrant"),
    ("apache", "apache(?: software)? licen[sc]e", "licen"),
    ("bsd", "bsd(?: style)? licen[sc]e", "licen"),
    ("gpl", "(?:gnu )?general public licen[sc]e", "licen"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "licen"),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "licen"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "licen"),
    ("mpl", "mozilla public licen[sc]e", "licen"),
    ("epl", "eclipse public licen[sc]e", "licen"),
    ("artistic", "artistic licen[sc]e", "licen"),
    ("creative-commons", "creative commons(?: licen[sc]e)?", "creative commons"),
    ("proprietary", "(?:proprietary|commercial) licen[sc]e", "licen"),
    ("eula", "end user licen[sc]e agreement", "licen"),
    ("mit-style", "(?:mit|x11) style licen[sc]e", "licen"),
    ("cddl", "common development and distribution licen[sc]e", "licen"),
    ("cecill", "cecill(?: [abc])? licen[sc]e", "cecill"),
    ("open-database", "open database licen[sc]e", "licen"),
    ("source-available", "source available licen[sc]e", "licen"),
    ("public-domain", "public domain", "public domain"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int

    @property
    def literal(self) -> str:
        """The longest text that every match holds, as far as groups, classes and quantifiers don't hide it."""
        bare, depth = [], 0
        for c in re.sub(r"(?:\\.|\[[^]]*\])(?:[?*+]|\{[^}]*\})?|[^()](?:[?*]|\{[^}]*\})|\{[^}]*\}", "\0", self.pattern):
            depth += (c == "(") - (c == ")")
            bare.append("\0" if depth or c in "()?*+" else c)
        return max("".join(bare).split("\0"), key=len).strip()


def rules() -> list[Rule]:
    """All rules in their order; of equally strong rules with the same span, the first wins."""
    found = [Rule(label, pattern, keyword, TEXT) for label, pattern, keyword in TEXTS]
    for label, name, tag, keyword in LICENSES:
        # no word may stand in all forms of a name: "gpl" in the short one, "general public" in the long one
        for word in keyword.split("|"):
            found += [Rule(label, _NOTICE + name, word, NOTICE), Rule(label, name, word, NAME)]
        if tag:
            found.append(Rule(label, f"spdx license identifier {tag}", "spdx", NOTICE))
    for label, short, long in _CC:
        for version, suffix in (("", ""), ("-1", " 1(?: 0)?"), ("-2", " 2(?: [05])?"), ("-3", " 3(?: 0)?"), ("-4", " 4(?: 0)?")):
            found += [
                Rule(label + version, f"{_NOTICE}(?:a )?cc {short}{suffix}", "cc by", NOTICE),
                Rule(label + version, f"cc {short}{suffix}", "cc by", NAME),
                Rule(label + version, f"creative commons {long}(?: licen[sc]e)?(?: version)?(?: international| unported| generic)?{suffix}", "creative commons", NAME),
            ]
        found.append(Rule(label, f"spdx license identifier cc {short} [1234] \\d", "spdx", NOTICE))
    found += [Rule("cc0-1", f"{notice}(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", word, level) for word in ("cc0", "cc zero", "creative commons") for notice, level in ((_NOTICE, NOTICE), ("", NAME))]
    return found + [Rule(label, pattern, keyword, LOOSE) for label, pattern, keyword in LOOSES]
