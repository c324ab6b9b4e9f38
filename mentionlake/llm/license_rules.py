"""The signature rules of the license scan, in the order of their priority, by hand.

A rule is (label, keyword, expression, confidence). It reads the words of a text, lower-cased and joined by one space; a version such as 2.0 is two words there. The
keyword is one or more whole words that every match holds. `{v}` in a label is the version that the expression's first group has, with `.` for spaces. Groups of rules that differ in a name or a
version only are written as tables of these. Notices and tags come first, then names with versions, then sentences of license texts, then bare names.
"""

from __future__ import annotations

#: Words between a name and its version.
V, OR_LATER = r"(?: v| version| versions| license v| license version| public license v| public license version)?", r" or (?:at your option )?(?:any )?(?:later|newer|greater)(?: version)?"

#: SPDX identifiers as they stand in a tag; hyphens and dots are spaces here.
TAGS = [
    "0bsd", "aal", "afl 1 1", "afl 1 2", "afl 2 0", "afl 2 1", "afl 3 0", "agpl 1 0", "agpl 3 0", "apache 1 0", "apache 1 1", "apache 2 0", "apsl 1 0", "apsl 1 1", "apsl 2 0", "artistic 1 0", "artistic 2 0",
    "beerware", "bittorrent 1 1", "blueoak 1 0 0", "bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 3 clause", "bsd 3 clause clear", "bsd 4 clause", "bsl 1 0", "busl 1 1", "bzip2 1 0 6",
    "cc0 1 0", "cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0", "cc by nc 2 0", "cc by nc 3 0", "cc by nc 4 0", "cc by nc nd 3 0", "cc by nc nd 4 0", "cc by nc sa 2 0", "cc by nc sa 3 0",
    "cc by nc sa 4 0", "cc by nd 3 0", "cc by nd 4 0", "cc by sa 2 0", "cc by sa 2 5", "cc by sa 3 0", "cc by sa 4 0", "cddl 1 0", "cddl 1 1", "cecill 1 0", "cecill 2 0", "cecill 2 1", "cecill b", "cecill c",
    "cern ohl p 2 0", "cern ohl s 2 0", "cern ohl w 2 0", "cpal 1 0", "cpl 1 0", "curl", "ecl 1 0", "ecl 2 0", "efl 2 0", "elastic 2 0", "epl 1 0", "epl 2 0", "eupl 1 0", "eupl 1 1", "eupl 1 2", "fsfap", "ftl",
    "gfdl 1 1", "gfdl 1 2", "gfdl 1 3", "gpl 1 0", "gpl 2 0", "gpl 3 0", "hpnd", "icu", "ijg", "imagemagick", "intel", "ipl 1 0", "isc", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "libpng 2 0", "libtiff", "lppl 1 0",
    "lppl 1 2", "lppl 1 3a", "lppl 1 3c", "mit", "mit 0", "mpl 1 0", "mpl 1 1", "mpl 2 0", "ms pl", "ms rl", "mulanpsl 1 0", "mulanpsl 2 0", "ncsa", "nist pd", "npl 1 0", "npl 1 1", "ntp", "odbl 1 0", "odc by 1 0",
    "ofl 1 0", "ofl 1 1", "oldap 2 8", "openssl", "osl 1 0", "osl 2 0", "osl 2 1", "osl 3 0", "php 3 0", "php 3 01", "postgresql", "psf 2 0", "python 2 0", "qpl 1 0", "rpl 1 1", "rpl 1 5", "ruby", "sgi b 2 0",
    "sissl", "sleepycat", "spl 1 0", "sspl 1 0", "tcl", "unicode dfs 2016", "unlicense", "upl 1 0", "vim", "w3c", "wtfpl", "x11", "xfree86 1 1", "zlib", "zpl 1 1", "zpl 2 0", "zpl 2 1",
]

#: Names that come with a version: (label, keyword, expression of the name, version expressions).
VERSIONED = [
    ("agpl", "affero", r"(?:gnu )?affero general public license", r"1|3"), ("agpl", "agpl", r"(?:gnu )?agpl", r"1|3"), ("lgpl", "lesser", r"(?:gnu )?lesser general public license", r"2 1|3|2"), ("lgpl", "library", r"(?:gnu )?library general public license", r"2 0|2"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", r"2 1|3|2"), ("gpl", "general public license", r"(?:gnu )?general public license", r"1|2|3"), ("gpl", "gpl", r"(?:gnu )?gpl", r"1|2|3"), ("gfdl", "documentation", r"(?:gnu )?free documentation license", r"1 1|1 2|1 3"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", r"1 1|1 2|1 3"), ("apache", "apache", r"apache(?: software)?(?: license)?", r"1 0|1 1|2 0|2"), ("asl", "asl", r"asl", r"1 1|2 0"), ("mpl", "mozilla", r"mozilla(?: public)?(?: license)?", r"1 0|1 1|2 0"), ("mpl", "mpl", r"mpl", r"1 0|1 1|2 0"),
    ("npl", "netscape", r"netscape public license", r"1 0|1 1"), ("epl", "eclipse", r"eclipse public license", r"1 0|2 0"), ("epl", "epl", r"epl", r"1 0|2 0"), ("eupl", "european union", r"european union public licen[cs]e", r"1 0|1 1|1 2"), ("eupl", "eupl", r"eupl", r"1 0|1 1|1 2"),
    ("cddl", "common development", r"common development and distribution license", r"1 0|1 1"), ("cddl", "cddl", r"cddl", r"1 0|1 1"), ("cpl", "common public", r"common public license", r"0 5|1 0"), ("cpl", "cpl", r"cpl", r"1 0"), ("cpal", "attribution", r"common public attribution license", r"1 0"),
    ("artistic", "artistic", r"artistic license", r"1 0|2 0"), ("boost", "boost", r"boost software license", r"1 0"), ("bsl", "bsl", r"bsl", r"1 0|1 1"), ("busl", "business source", r"business source license", r"1 1"), ("sspl", "server side", r"server side public license", r"1"),
    ("sspl", "sspl", r"sspl", r"1"), ("elastic", "elastic", r"elastic license", r"1 0|2 0"), ("ofl", "font", r"(?:sil )?open font license", r"1 0|1 1"), ("ofl", "ofl", r"(?:sil )?ofl", r"1 0|1 1"), ("osl", "open software", r"open software license", r"1 0|2 0|2 1|3 0"), ("osl", "osl", r"osl", r"2 0|2 1|3 0"),
    ("afl", "academic free", r"academic free license", r"1 2|2 0|2 1|3 0"), ("afl", "afl", r"afl", r"2 1|3 0"), ("ecl", "educational", r"educational community license", r"1 0|2 0"), ("cecill", "cecill", r"cecill(?: free software license agreement)?", r"1 0|1 1|2 0|2 1"),
    ("lppl", "latex", r"latex project public license", r"1 0|1 1|1 2|1 3"), ("lppl", "lppl", r"lppl", r"1 0|1 2|1 3"), ("qpl", "q public", r"q public license", r"1 0"), ("rpl", "reciprocal", r"reciprocal public license", r"1 1|1 5"), ("sleepycat", "sleepycat", r"sleepycat license", r"1"),
    ("apsl", "apple", r"apple public source license", r"1 0|1 1|1 2|2 0"), ("ipl", "ibm", r"ibm public license", r"1 0"), ("spl", "sun", r"sun public license", r"1 0"), ("zpl", "zope", r"zope public license", r"1 1|2 0|2 1"), ("php", "php", r"php license", r"3 0|3 01"),
    ("psf", "python", r"python(?: software foundation)? license", r"2"), ("unicode", "unicode", r"unicode(?: inc)? license", r"2 0|3"), ("upl", "universal permissive", r"universal permissive license", r"1 0"), ("mulan", "mulan", r"mulan (?:permissive software|psl)(?: license)?", r"1|2"),
    ("odbl", "database", r"open (?:data commons open )?database license", r"1 0"), ("odc-by", "commons attribution", r"open data commons attribution license", r"1 0"), ("pddl", "pddl", r"pddl", r"1 0"), ("cc0", "cc0", r"cc0", r"1 0"), ("wtfpl", "wtfpl", r"wtfpl", r"1|2"),
    ("bittorrent", "bittorrent", r"bittorrent open source license", r"1 0|1 1"), ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield) license", r"1 0 0"), ("hippocratic", "hippocratic", r"hippocratic license", r"1 0|2 0|2 1|3 0"), ("openrail", "openrail", r"(?:bigscience )?openrail(?: m)?", r"1|1 0"),
    ("commons-clause", "commons clause", r"commons clause license condition", r"1 0"), ("parity", "parity", r"parity public license", r"6 0|7 0"), ("prosperity", "prosperity", r"prosperity public license", r"2 0|3 0"), ("ogl", "government", r"open government licen[cs]e", r"1 0|2 0|3 0"),
]

#: Creative Commons: parts of a name, spelled and short.
CC = [("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|ative|atives)(?: works)?", "by nc nd"), ("by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"), ("by-nc", "attribution non ?commercial", "by nc"), ("by-nd", "attribution no ?deriv(?:s|ative|atives)(?: works)?", "by nd"), ("by-sa", "attribution share ?alike", "by sa"), ("by", "attribution", "by")]
CC_VERSION = r"1 0|2 0|2 1|2 5|3 0|4 0"

#: Sentences of license texts and notices: (label, keyword, expression, confidence).
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0), ("mit", "without restriction", r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 1.0),
    ("mit", "copyright notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", 1.0), ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement", 0.8),
    ("mit", "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: x11)? licen[cs]e", 1.0), ("mit", "expat", r"(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?expat licen[cs]e", 1.0), ("mit", "x11", r"(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?x11 licen[cs]e", 0.9), ("mit-0", "attribution", r"mit no attribution(?: license)?", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0), ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions", 1.0), ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 1.0),
    ("bsd-3-clause", "endorse", r"(?:may|nor) (?:be used|the names of its contributors may be used) to endorse or promote products derived from this software without specific prior written permission", 0.9), ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|two clause bsd|2 clause bsd)(?: license)?", 1.0), ("bsd-2-clause", "freebsd", r"freebsd (?:documentation )?license", 1.0), ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|three clause bsd|3 clause bsd)(?: license)?", 1.0), ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|four clause bsd|4 clause bsd)(?: license)?", 1.0),
    ("bsd-0-clause", "0bsd", r"0bsd", 1.0), ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", 1.0), ("bsd", "bsd", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)? licen[cs]e", 1.0), ("bsd", "bsd style", r"bsd style licen[cs]e", 0.8),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0), ("gpl", "without even", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 1.0),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license", 1.0), ("gpl", "gpl", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl", 1.0), ("gpl", "copyleft", r"copyleft licenses? for software and other kinds of works", 0.9),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0), ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license", 1.0), ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public license", 1.0),
    ("gpl-exception", "exception", r"(?:gcc runtime library|classpath|autoconf|bison|font|openssl|linking) exception", 0.8), ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 1.0), ("gfdl", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("apache", "apache", r"licensed under the apache license", 1.0), ("apache", "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.9), ("apache", "apache", r"http(?:s)? www apache org licenses license(?: 2 0)?", 1.0), ("apache", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.9),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license", 1.0), ("mpl", "mozilla", r"http(?:s)? (?:www )?mozilla org mpl(?: 2 0)?", 1.0), ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public license", 1.0), ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("epl", "eclipse", r"http(?:s)? www eclipse org legal epl(?: v10| 2 0| v20)?", 1.0), ("cddl", "development", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0), ("eupl", "eupl", r"licensed under the eupl", 1.0), ("isc", "isc", r"(?:the )?isc license", 1.0),
    ("isc", "any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0), ("hpnd", "any purpose", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted", 1.0),
    ("zlib", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0), ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented", 1.0), ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? license", 1.0), ("libpng", "libpng", r"(?:the )?libpng license", 1.0),
    ("boost", "boost", r"distributed under the boost software license", 1.0), ("boost", "machine executable", r"solely in the form of machine executable object code generated by a source language processor", 1.0), ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0), ("unlicense", "unlicense", r"(?:the )?unlicense(?: org)?", 0.9),
    ("wtfpl", "what the", r"do what the (?:fuck|fork) you want to public license", 1.0), ("wtfpl", "wtfpl", r"wtfpl", 0.9), ("beerware", "beer", r"(?:the )?beer ?ware license", 1.0), ("beerware", "beer", r"you can buy me a beer in return", 1.0), ("json", "evil", r"the software shall be used for good not evil", 1.0),
    ("public-domain", "public domain", r"(?:dedicated|placed|released|committed) (?:in)?to the public domain", 1.0), ("public-domain", "public domain", r"(?:is|are) in the public domain", 0.9), ("public-domain", "domain dedication", r"public domain dedication", 0.9), ("public-domain", "public domain", r"public domain mark 1 0", 1.0), ("public-domain", "gemeinfrei", r"gemeinfrei", 0.7),
    ("public-domain", "domaine public", r"domaine public", 0.7), ("public-domain", "dominio", r"dominio p[úu]blico", 0.7), ("cc0", "cc0", r"cc0(?: universal)?", 0.9), ("cc0", "creative commons zero", r"creative commons zero(?: 1 0)?(?: universal)?", 1.0), ("cc0", "waived", r"has waived all copyright and related or neighboring rights", 1.0),
    ("cc", "creativecommons", r"creativecommons org publicdomain (?:zero|mark)(?: 1 0)?", 1.0), ("cc", "creative commons", r"licensed under (?:a )?creative commons", 0.9), ("cc", "creative commons", r"creative commons licen[cs]e", 0.7), ("cc", "creative commons", r"licence creative commons", 0.7), ("cc", "creative commons", r"licencia creative commons", 0.7),
    ("openssl", "openssl", r"(?:the )?openssl license", 1.0), ("openssl", "openssl", r"this product includes software developed by the openssl project", 1.0), ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 1.0), ("postgresql", "postgresql", r"(?:the )?postgresql licen[cs]e", 1.0), ("ruby", "ruby", r"(?:the )?ruby license", 0.9),
    ("ruby", "ruby", r"same terms as ruby(?: itself)?", 1.0), ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?", 1.0), ("artistic", "artistic", r"(?:the )?(?:perl )?artistic license", 0.9), ("python", "psf", r"psf license(?: agreement)?", 0.9), ("python", "python", r"python software foundation license", 1.0), ("tcl", "tcl", r"tcl tk license", 1.0),
    ("vim", "vim", r"(?:the )?vim license", 1.0), ("curl", "curl", r"(?:the )?curl license", 1.0), ("ijg", "jpeg", r"based in part on the work of the independent jpeg group", 1.0), ("freetype", "freetype", r"(?:the )?freetype (?:project )?license", 1.0), ("freetype", "freetype", r"portions of this software are copyright .{0,40}the freetype project", 1.0), ("icu", "icu", r"icu license", 0.9),
    ("ncsa", "ncsa", r"(?:university of illinois ncsa|ncsa) open source license", 1.0), ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license", 1.0), ("ms-pl", "microsoft", r"microsoft public license", 1.0), ("ms-rl", "microsoft", r"microsoft reciprocal license", 1.0), ("ms-pl", "ms pl", r"ms pl", 0.8), ("intel", "intel", r"intel open source license", 1.0),
    ("ofl", "font", r"this font software is licensed under the sil open font license", 1.0), ("ofl", "reserved font", r"with reserved font names?", 0.9), ("ofl", "font", r"(?:sil )?open font license", 0.9), ("imagemagick", "imagemagick", r"imagemagick license", 1.0), ("xfree86", "xfree86", r"xfree86 license", 1.0), ("x11", "x consortium", r"x consortium shall not be used in advertising", 1.0),
    ("sissl", "sun industry", r"sun industry standards source license", 1.0), ("nist", "this software was developed", r"this software was developed (?:at|by employees of) (?:the )?(?:nist|national institute of standards and technology)", 1.0), ("us-government", "united states", r"work of the united states government", 0.9), ("nasa", "nasa", r"nasa open source agreement", 1.0),
    ("ogl", "government", r"contains public sector information licensed under the open government licen[cs]e", 1.0), ("etalab", "ouverte", r"licence ouverte(?: open licence)?(?: etalab)?", 0.9), ("etalab", "etalab", r"etalab(?: 2 0)?", 0.7), ("dl-de", "deutschland", r"datenlizenz deutschland", 1.0), ("odbl", "odbl", r"odbl", 0.9), ("osm", "openstreetmap", r"openstreetmap contributors", 0.7), ("llama", "llama", r"(?:meta )?llama (?:2|3|3 1|3 2|3 3) community license", 1.0),
    ("gemma", "gemma", r"gemma terms of use", 1.0), ("openrail", "responsible ai", r"(?:open )?responsible ai license", 1.0), ("openrail", "bigscience", r"bigscience (?:bloom )?rail", 1.0), ("polyform", "polyform", r"polyform (?:noncommercial|strict|shield)", 0.9), ("commons-clause", "commons clause", r"commons clause", 0.8), ("sspl", "server side", r"server side public license", 1.0), ("busl", "business source", r"business source license", 1.0),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary", 0.9), ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|software|document|work) )?(?:via any medium )?is (?:strictly )?prohibited", 1.0), ("proprietary", "trade secret", r"contains? trade secrets?", 0.8),
    ("proprietary", "end user", r"end user licen[cs]e agreement", 1.0), ("proprietary", "eula", r"eula", 0.7), ("proprietary", "no part of this", r"no part of this (?:publication|book|work|document|file) may be reproduced", 1.0), ("proprietary", "evaluation", r"for evaluation (?:purposes )?only", 0.6), ("proprietary", "reverse", r"(?:reverse engineer|reverse engineering) decompil(?:e|ation)", 0.8),
    ("noncommercial", "non commercial", r"(?:for )?non commercial (?:use|purposes?)(?: only)?", 0.7), ("noncommercial", "noncommercial", r"(?:for )?noncommercial (?:use|purposes?)(?: only)?", 0.7), ("noncommercial", "academic", r"for academic (?:and research )?(?:use|purposes?) only", 0.8), ("noncommercial", "personal", r"for personal use only", 0.7), ("noncommercial", "research", r"for research (?:use|purposes?) only", 0.8),
    ("all-rights-reserved", "all rights", r"all rights reserved", 0.6), ("all-rights-reserved", "alle rechte", r"alle rechte vorbehalten", 0.6), ("all-rights-reserved", "tous droits", r"tous droits r[ée]serv[ée]s", 0.6), ("all-rights-reserved", "todos los derechos", r"todos los derechos reservados", 0.6), ("all-rights-reserved", "todos os direitos", r"todos os direitos reservados", 0.6),
    ("copyright", "copyright", r"copyright (?:c |© )?(?:19|20)\d\d", 0.4), ("copyright", "copyright", r"copyright notice", 0.3), ("warranty", "as is", r"provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)(?: of any kind)?", 0.5), ("warranty", "no event", r"in no event shall (?:the )?(?:authors?|copyright (?:holders?|owner)|regents)", 0.5), ("warranty", "no warranty", r"comes with absolutely no warranty|no warranty", 0.4),
    ("dual", "dual", r"dual licensed(?: under)?", 0.5), ("open-source", "open source", r"open source licen[cs]e", 0.4), ("see-license", "license", r"see (?:the )?(?:accompanying )?license(?: file)?(?: txt| md)? for (?:details|more information|terms)", 0.5), ("see-license", "license", r"license that can be found in the license file", 0.6),
]

#: Names alone: the weakest. (label, name)
NAMES = [
    ("gpl", "gpl"), ("gpl", "gplv2"), ("gpl", "gplv3"), ("lgpl", "lgpl"), ("lgpl", "lgplv2"), ("lgpl", "lgplv3"), ("lgpl", "gnu lesser general public license"), ("agpl", "agpl"), ("agpl", "agplv3"), ("agpl", "gnu affero general public license"), ("gfdl", "gfdl"), ("gfdl", "gnu free documentation license"),
    ("mpl", "mozilla public license"), ("epl", "eclipse public license"), ("eupl", "european union public licence"), ("eupl", "eupl"), ("cddl", "cddl"), ("bsd", "bsd license"), ("bsd", "bsd licence"), ("mit", "mit licence"), ("mit", "mit licensed"), ("mit", "expat license"), ("mit", "x11 license"), ("apache", "apache licence"),
    ("apache", "apache software license"), ("boost", "boost software license"), ("artistic", "artistic license"), ("osl", "open software license"), ("afl", "academic free license"), ("cecill", "cecill"), ("lppl", "lppl"), ("zpl", "zope public license"), ("php", "php license"), ("ecl", "educational community license"), ("upl", "universal permissive license"),
    ("cpl", "common public license"), ("apsl", "apple public source license"), ("ogl", "open government licence"), ("odbl", "open database license"), ("elastic", "elastic license"), ("cc-by", "creative commons attribution"),
]


def rules() -> list[tuple[str, str, str, float]]:
    """All rules, first those that win over others: tags, names with versions, sentences, names."""
    tags = [(t.replace(" ", "-"), "spdx license identifier", f"spdx license identifier {t}(?: only| or later)?", 1.0) for t in sorted(TAGS, key=len, reverse=True)]
    named = []
    for label, keyword, name, version in VERSIONED:
        named += [(f"{label}-{{v}}-or-later", keyword, f"{name}{V} ?({version})(?: 0)?{OR_LATER}", 1.0), (f"{label}-{{v}}", keyword, f"{name}{V} ?({version})", 0.9)]
    for label, spelled, short in CC:
        named += [(f"cc-{label}-{{v}}", "creative commons", f"creative commons {spelled}(?: license| licence)? ({CC_VERSION})", 1.0), (f"cc-{label}-{{v}}", f"cc {short}", f"cc {short} ({CC_VERSION})", 1.0)]
        named += [(f"cc-{label}-{{v}}", "creativecommons", f"creativecommons org licenses {short} ({CC_VERSION})", 1.0), (f"cc-{label}", "creative commons", f"creative commons {spelled}", 0.8), (f"cc-{label}", f"cc {short}", f"cc {short}", 0.8)]
    return [*tags, *named, *SENTENCES, *((label, name, name, 0.6) for label, name in NAMES)]
