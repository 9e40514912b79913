"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased (A-Z only), and its white space and the comment marks at the ends of its lines
are folded to single spaces, so a wrapped notice reads as one line. One Aho-Corasick pass finds which rule keywords occur; only
the rules with a keyword present run their regex, in order of priority. Overlapping detections
are resolved by interval containment: a detection that lies inside an accepted one of the same
or a higher priority is suppressed. Base phrases are counted apart, on word boundaries, and are
never suppressed.

Defined results: null and empty texts have no words and no labels (score 0); very long texts are read
whole; an empty table gives no rows; repeated rows give
repeated results; extra columns are ignored; rows are independent, so ties cannot arise between
rows, and ties between rules go to the earlier start, then the longer match, then rule order.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_lists, map_arrow

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Versioned families as (label, name regex, keyword, versions).
FAMILIES = [
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|\bgpl", ("general public", "gpl"), ("1", "2", "3")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|\blgpl", ("lesser general", "library general", "lgpl"), ("2", "2.1", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|\bagpl", ("affero", "agpl"), ("1", "3")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|\bgfdl", ("free documentation", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", r"apache (?:software )?licen[cs]e|\basl", ("apache", "asl"), ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla public licen[cs]e|\bmpl", ("mozilla public", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e|\bepl", ("eclipse public", "epl"), ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e|\bcddl", ("common development", "cddl"), ("1.0", "1.1")),
    ("eupl", r"european union public licen[cs]e|\beupl", ("european union public", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", r"open software licen[cs]e|\bosl", ("open software", "osl"), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[cs]e|\bafl", ("academic free", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", r"artistic licen[cs]e", ("artistic",), ("1.0", "2.0")),
    ("bsl", r"boost software licen[cs]e|\bbsl", ("boost software", "bsl"), ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e|\bcpl", ("common public", "cpl"), ("1.0",)),
    ("ofl", r"(?:sil )?open font licen[cs]e|\bofl", ("open font", "ofl"), ("1.0", "1.1")),
    ("zpl", r"zope public licen[cs]e|\bzpl", ("zope", "zpl"), ("1.1", "2.0", "2.1")),
    ("php", r"php licen[cs]e", ("php",), ("3.0", "3.01")),
    ("python", r"python (?:software foundation )?licen[cs]e|\bpsf", ("python", "psf"), ("2", "2.0")),
    ("lppl", r"latex project public licen[cs]e|\blppl", ("latex project", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e|\bodbl", ("database", "odbl"), ("1.0",)),
]
# Creative Commons element sets and versions.
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "attribution", "sa": "share ?-?alike", "nc": "non-?commercial", "nd": "no ?-?deriv(?:ative)?s?(?: works)?"}
# Licenses known by their name before the word license, as label and name.
NAMED = [
    ("aal", "attribution assurance"),
    ("adobe-2006", "adobe systems incorporated source code"),
    ("adobe-glyph", "adobe glyph list"),
    ("aladdin", "aladdin free public"),
    ("amazon", "amazon software"),
    ("apl", "adaptive public"),
    ("apsl", "apple public source"),
    ("arphic", "arphic public"),
    ("bittorrent", "bittorrent open source"),
    ("blueoak", "blue oak model"),
    ("bsd-protection", "bsd protection"),
    ("busl", "business source"),
    ("catosl", "computer associates trusted open source"),
    ("clartistic", "clarified artistic"),
    ("cnri", "cnri open source"),
    ("condor", "condor public"),
    ("cpal", "common public attribution"),
    ("cpol", "code project open"),
    ("cua-opl", "cua office public"),
    ("curl", "curl"),
    ("drl", "detection rule"),
    ("ecl", "educational community"),
    ("efl", "eiffel forum"),
    ("elastic", "elastic"),
    ("entessa", "entessa public"),
    ("erlpl", "erlang public"),
    ("etalab", "etalab open"),
    ("eudatagrid", "eu datagrid software"),
    ("fair", "fair"),
    ("fair-source", "fair source"),
    ("frameworx", "frameworx open"),
    ("free-art", "free art"),
    ("freeimage", "freeimage public"),
    ("fsl", "functional source"),
    ("ftl", "freetype project"),
    ("giftware", "giftware"),
    ("gl2ps", "gl2ps"),
    ("gnuplot", "gnuplot"),
    ("gutenberg", "project gutenberg"),
    ("hippocratic", "hippocratic"),
    ("icu", "icu"),
    ("imagemagick", "imagemagick"),
    ("info-zip", "info-zip"),
    ("intel", "intel open source"),
    ("interbase", "interbase public"),
    ("ipa", "ipa font"),
    ("ipl", "ibm public"),
    ("jasper", "jasper"),
    ("json", "json"),
    ("leptonica", "leptonica"),
    ("libpng", "libpng"),
    ("libtiff", "libtiff"),
    ("lpl", "lucent public"),
    ("miros", "miros"),
    ("motosoto", "motosoto open source"),
    ("ms-lpl", "microsoft limited public"),
    ("multics", "multics"),
    ("naumen", "naumen public"),
    ("net-snmp", "net-snmp"),
    ("netcdf", "netcdf"),
    ("ngpl", "nethack general public"),
    ("nokia", "nokia open source"),
    ("nosl", "netizen open source"),
    ("npl", "netscape public"),
    ("npsl", "nmap public source"),
    ("ntp", "ntp"),
    ("occt", "open cascade technology public"),
    ("oclc", "oclc research public"),
    ("odc-by", "open data commons attribution"),
    ("ogl", "open government"),
    ("ogtsl", "open group test suite"),
    ("oldap", "openldap public"),
    ("oml", "open market"),
    ("openssl", "openssl"),
    ("opl", "open publication"),
    ("oset", "oset public"),
    ("parity", "parity public"),
    ("postgresql", "postgresql"),
    ("qpl", "q public"),
    ("rpl", "reciprocal public"),
    ("rpsl", "realnetworks public source"),
    ("rscpl", "ricoh source code public"),
    ("ruby", "ruby"),
    ("sgi-b", "sgi free software"),
    ("simpl", "simple public"),
    ("sissl", "sun industry standards source"),
    ("sleepycat", "sleepycat"),
    ("spl", "sun public"),
    ("sspl", "server side public"),
    ("sugarcrm", "sugarcrm public"),
    ("tosl", "trusster open source"),
    ("ucl", "upstream compatibility"),
    ("upl", "universal permissive"),
    ("vim", "vim"),
    ("vsl", "vovida software"),
    ("watcom", "sybase open watcom public"),
    ("wxwindows", "wxwindows library"),
    ("xfree86", "xfree86"),
    ("zend", "zend"),
    ("zimbra", "zimbra public"),
]
# Signatures of names and sentences, as (label, regex, keyword).
SINGLE = [
    ("0bsd", r"\bbsd zero[- ]clause\b|\bzero[- ]clause bsd\b|\b0bsd\b", "bsd"),
    ("agpl", r"gnu\.org/licenses/agpl", "gnu.org/licenses"),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org/licenses"),
    ("artistic", r"maintains some semblance of artistic control", "semblance of artistic"),
    ("beerware", r"beer-?ware licen[cs]e", "beer"),
    ("bsd", r"\bbsd(?:-style)? licen[cs]e\b", "bsd"),
    ("bsd", r"opensource\.org/licenses/bsd", "opensource.org/licenses"),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution and use"),
    ("bsd-1-clause", r"\bbsd[- ]1[- ]clause\b|\b1[- ]clause bsd\b", "bsd"),
    ("bsd-2-clause", r"\b(?:bsd[- ]2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd licen[cs]e)\b", "bsd"),
    ("bsd-3-clause", r"\b(?:bsd[- ]3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd)\b", "bsd"),
    ("bsd-3-clause", r"neither the names? of [^.]{1,200}? nor the names of its contributors may be used to endorse", "names of its contributors"),
    ("bsd-4-clause", r"\b(?:bsd[- ]4[- ]clause|4[- ]clause bsd|original bsd|old bsd)\b", "bsd"),
    ("bsd-4-clause", r"advertising materials mentioning features or use of this software", "advertising materials mentioning"),
    ("bsl-1.0", r"to any person or organization obtaining a copy of the software and accompanying documentation", "accompanying documentation"),
    ("c-uda", r"computational use of data agreement", "computational use"),
    ("cc0", r"\bcc0\b", "cc0"),
    ("cc0", r"creative commons zero", "commons zero"),
    ("cc0", r"waives? all (?:of (?:his|her|their) )?(?:copyright and related|rights to the work)", "waive"),
    ("cecill", r"\bcecill(?:-[bc])?\b", "cecill"),
    ("copyleft-next", r"\bcopyleft-next\b", "copyleft-next"),
    ("d-fsl", r"deutsche freie software lizenz", "freie software lizenz"),
    ("dco", r"developer certificate of origin", "certificate of origin"),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz"),
    ("etalab", r"licence ouverte", "licence ouverte"),
    ("free-art", r"licence art libre", "art libre"),
    ("fsf-unlimited", r"gives unlimited permission to copy and/or distribute it", "unlimited permission"),
    ("fsfap", r"are permitted in any medium without royalty", "without royalty"),
    ("gfdl", r"permission is granted to copy, distribute and/or modify this document under the terms", "modify this document"),
    ("gpl", r"gnu\.org/licenses/gpl", "gnu.org/licenses"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied"),
    ("hpnd", r"historical permission notice and disclaimer", "historical permission"),
    ("ijg", r"independent jpeg group", "independent jpeg"),
    ("imatix", r"imatix standard function library agreement", "imatix"),
    ("isc", r"\bisc licen[cs]e\b", "isc"),
    ("isc", r"opensource\.org/licenses/isc", "opensource.org/licenses"),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use"),
    ("jsr", r"the software shall be used for good, not evil", "good, not evil"),
    ("lgpl", r"gnu\.org/licenses/lgpl", "gnu.org/licenses"),
    ("llama", r"llama [234](?:\.\d)? community licen[cs]e", "community licen"),
    ("mit", r"\bexpat licen[cs]e\b", "expat"),
    ("mit", r"\bmit[- ]licen[cs]ed?\b", "mit"),
    ("mit", r"\bx11 licen[cs]e\b", "x11"),
    ("mit", r"opensource\.org/licenses/mit", "opensource.org/licenses"),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted"),
    ("mit-0", r"\bmit no attribution\b|\bmit-0\b", "mit"),
    ("mpl-2.0", r"this source code form is subject to the terms", "source code form is subject"),
    ("mpl", r"mozilla\.org/mpl", "mozilla.org/mpl"),
    ("ms-pl", r"\bms-pl\b", "ms-pl"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft public"),
    ("ms-rl", r"\bms-rl\b", "ms-rl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "reciprocal"),
    ("ms-terms", r"microsoft software licen[cs]e terms", "microsoft software"),
    ("mulan", r"mulan (?:permissive software|public) licen[cs]e", "mulan"),
    ("nasa", r"nasa open source agreement", "nasa open source"),
    ("ncsa", r"university of illinois/ncsa|ncsa open source licen[cs]e", "ncsa"),
    ("no-known-copyright", r"no known copyright restrictions|free of known (?:copyright )?restrictions", "restrictions"),
    ("ofl", r"reserved font name", "reserved font name"),
    ("openrail", r"\b(?:creativeml )?open ?rail(?:\+\+)?(?:-[ms]+)?\b", "rail"),
    ("pddl", r"public domain dedication and licen[cs]e", "domain dedication"),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)", "polyform"),
    ("proprietary", r"all rights reserved", "rights reserved"),
    ("proprietary", r"no part of this (?:publication|book|work) may be reproduced", "may be reproduced"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)[^.]{0,100}? is (?:strictly )?prohibited", "prohibited"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in)?to the public domain|in the public domain", "public domain"),
    ("public-domain", r"not subject to copyright protection", "subject to copyright"),
    ("tcl", r"tcl/tk licen[cs]e", "tcl/tk"),
    ("unicode", r"unicode (?:data files and software )?licen[cs]e", "unicode"),
    ("unlicense", r"\bunlicense\b", "unlicense"),
    ("unlicense", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute", "anyone is free to copy"),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c"),
    ("wtfpl", r"\bwtfpl\b", "wtfpl"),
    ("wtfpl", r"do what the f\w* you want to", "do what the f"),
    ("ypl", r"yahoo! public licen[cs]e", "yahoo! public"),
    ("zlib", r"\bzlib(?:/libpng)? licen[cs]e\b", "zlib"),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source versions"),
]
# Sentences that stand in license texts and notices, as (label, regex, keyword).
SENTENCES = [
    ("agpl", r"interacting with it remotely through a computer network", "remotely through a computer network"),
    ("agpl", r"an opportunity to receive the corresponding source of your version", "corresponding source of your version"),
    ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the license", "agreed to in writing"),
    ("apache", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", "each contributor hereby grants to you"),
    ("apache", r"you must cause any modified files to carry prominent notices stating that you changed the files", "carry prominent notices"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "developed by the apache"),
    ("apsl", r"this file contains original code and/or modifications of original code as defined in and that are subject to the apple", "original code and/or modifications"),
    ("artistic", r"you may make and give away verbatim copies of the source form", "give away verbatim copies"),
    ("artistic", r"you may distribute this package in aggregate with other", "this package in aggregate"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes", "this license establishes"),
    ("beerware", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer", "worth it, you can buy me"),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author|authors)(?: and contributors)? [\"'`]*as is", "this software is provided by the"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source code"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form"),
    ("bsd-3-clause", r"may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission", "endorse or promote products derived"),
    ("bsd-4-clause", r"this product includes software developed by the university of california", "developed by the university of california"),
    ("bsd-patent", r"subject to the terms and conditions of this license, each copyright holder and contributor hereby grants to those receiving rights", "holder and contributor hereby grants"),
    ("bsl-1.0", r"must be included in all copies of the software, in whole or in part, and all derivative works of the software", "in whole or in part, and all derivative works"),
    ("busl", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use", "make non-production use"),
    ("cc", r"you are free to share [-\u2013\u2014]* ?copy and redistribute the material in any medium or format", "redistribute the material in any medium"),
    ("cc", r"to view a copy of this license, visit https?://creativecommons\.org", "to view a copy of this license"),
    ("cc", r"the work \(as defined below\) is provided under the terms of this creative commons public license", "this creative commons public"),
    ("cc", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made", "give appropriate credit"),
    ("cc-nc", r"you may not use the material for commercial purposes", "the material for commercial purposes"),
    ("cc-nd", r"if you remix, transform, or build upon the material, you may not distribute the modified material", "may not distribute the modified material"),
    ("cc-sa", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license", "contributions under the same license"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "associated a work with this deed"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution", "subject to the terms of the common development"),
    ("cecill", r"this software is governed by the cecill", "governed by the cecill"),
    ("commons-clause", r"the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software", "the right to sell the software"),
    ("curl", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
    ("dco", r"by making a contribution to this project, i certify that", "contribution to this project, i certify"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse", "under the terms of the eclipse"),
    ("epl", r"this program and the accompanying materials are licensed under the terms of the eclipse", "licensed under the terms of the eclipse"),
    ("eupl", r"licensed under the eupl", "under the eupl"),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "this instrument is retained"),
    ("freetype", r"portions of this software are copyright[^.]{0,80}the freetype project", "the freetype project"),
    ("gfdl", r"with no invariant sections, no front-cover texts,? and no back-cover texts", "no invariant sections"),
    ("gpl", r"this program is free software[:;,] you can redistribute it and/or modify", "this program is free software"),
    ("gpl", r"you should have received a copy of the gnu general public", "received a copy of the gnu general"),
    ("gpl", r"write to the free software foundation, inc", "write to the free software foundation"),
    ("gpl", r"this program comes with absolutely no warranty", "absolutely no warranty"),
    ("gpl", r"as a special exception, (?:the copyright holders|you may|if you link)", "as a special exception"),
    ("gpl-classpath", r"linking this library statically or dynamically with other modules is making a combined work", "making a combined work"),
    ("isc", r"the author disclaims all warranties with regard to this software", "disclaims all warranties with regard"),
    ("lgpl", r"this library is free software[:;,] you can redistribute it and/or modify", "this library is free software"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public", "received a copy of the gnu"),
    ("libpng", r"the contributing authors and group 42, inc\. disclaim all warranties", "contributing authors and group 42"),
    ("llama", r"built with (?:meta )?llama", "built with"),
    ("lppl", r"this work may be distributed and/or modified under the conditions of the latex project", "under the conditions of the latex"),
    ("lppl", r"this work has the lppl maintenance status", "lppl maintenance status"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    ("mit", r"the software is provided [\"'`]*as is[\"'`,]* without warranty of any kind, express or implied", "the software is provided"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability", "authors or copyright holders be liable"),
    ("mpl", r"the contents of this file are subject to the mozilla public", "subject to the mozilla public"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file, you can obtain one", "mpl was not distributed"),
    ("ms-eula", r"these license terms are an agreement between microsoft corporation", "between microsoft corporation"),
    ("ncsa", r"to deal with the software without restriction, including without limitation the rights", "to deal with the software without"),
    ("nvidia", r"nvidia corporation and its licensors retain all intellectual property and proprietary rights", "nvidia corporation and its licensors"),
    ("odbl", r"you are free to copy, distribute, transmit and adapt our data", "transmit and adapt our data"),
    ("odbl", r"this database is made available under the open database", "this database is made available"),
    ("ofl", r"the goals of the open font license \(ofl\) are to stimulate worldwide development", "goals of the open font"),
    ("ofl", r"this font software is licensed under the sil", "this font software is licensed"),
    ("ogl", r"contains public sector information licensed under the open government", "public sector information"),
    ("openssl", r"this product includes software developed by the openssl project", "developed by the openssl"),
    ("openssl", r"this product includes cryptographic software written by eric young", "cryptographic software written by"),
    ("php", r"this source file is subject to version 3\.0[01]? of the php", "source file is subject to version"),
    ("postgresql", r"in no event shall the university of california be liable to any party for direct, indirect, special, incidental", "university of california be liable"),
    ("proprietary", r"you may not copy, modify, (?:distribute|sublicense|reverse engineer)[^.]{0,80} without (?:the )?(?:prior |express )*written (?:consent|permission)", "you may not copy, modify"),
    ("proprietary", r"for internal use only", "internal use only"),
    ("proprietary", r"this software is the confidential and proprietary information of", "proprietary information of"),
    ("proprietary", r"subject to the end[- ]user licen[cs]e agreement", "subject to the end"),
    ("proprietary", r"reverse engineer, decompile,? or disassemble", "reverse engineer, decompile"),
    ("proprietary", r"trade secrets? (?:of|and confidential)", "trade secret"),
    ("public-domain", r"the author hereby disclaims copyright to this source code", "disclaims copyright to this source"),
    ("public-domain", r"this (?:file|code|software|work|program) is (?:hereby )?(?:placed )?in the public domain", "in the public domain"),
    ("public-domain", r"may you do good and not evil", "may you do good"),
    ("python", r"beopen\.com grants licensee|psf is making python available to licensee", "licensee"),
    ("qpl", r"you may copy this licen[cs]e document but may not change it", "but may not change it"),
    ("rail", r"you agree not to use the model or derivatives of the model", "derivatives of the model"),
    ("ruby", r"you may distribute the software in object code or binary form", "software in object code or binary"),
    ("sgi-b", r"the above copyright notice including the dates of first publication", "dates of first publication"),
    ("sleepycat", r"information on how to obtain complete source code for the (?:db )?software and any accompanying software", "obtain complete source code"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality of the program"),
    ("unicode", r"unicode data files do not include pdf online code charts", "unicode data files do not include"),
    ("unlicense", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate", "jurisdictions that recognize copyright"),
    ("upl", r"subject to the condition that the above copyright notice and either this complete permission notice", "either this complete permission notice"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "unmodified copies of vim"),
    ("w3c", r"notice of any changes or modifications(?:,)? (?:to|through) the (?:files|copyright notice)", "notice of any changes or modifications"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies"),
    ("wxwindows", r"the licensors give permission for you to use, copy, link, modify and distribute, under the user's own terms", "under the user's own terms"),
    ("zlib", r"this software is provided [\"'`]*as-is[\"'`,]* without any express or implied warranty", "without any express or implied"),
    ("zlib", r"the origin of this software must not be misrepresented", "must not be misrepresented"),
]
SPDX_PLAIN = ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "unlicense", "zlib", "cc0-1.0", "0bsd", "mit-0", "ncsa", "postgresql", "wtfpl", "x11", "ms-pl", "ms-rl", "bsl-1.0", "python-2.0", "artistic-1.0", "artistic-2.0")
_VERSION = r"(?:,? ?(?:\(\w+\))?,? ?(?:version |v\.? ?|-)?%s(?:\.0)?(?![\w.]*\d))"


def rules() -> list[tuple[int, str, str, tuple[str, ...]]]:
    """(priority, label, regex, keywords) of every signature rule, each once; a higher priority wins, and any keyword opens a rule."""
    out: list[tuple[int, str, str, tuple[str, ...]]] = []
    for label, name, keywords, versions in FAMILIES:
        for version in versions:
            short = version.removesuffix(".0") if version.endswith(".0") else version
            v = _VERSION % re.escape(short)
            out.append((50, f"{label}-{version}-or-later", rf"(?:{name}){v}(?:,? (?:or|and)(?: \(at your option\))? (?:any )?later|\+|-or-later)", keywords))
            out.append((45, f"{label}-{version}-only", rf"(?:{name}){v}(?: only|-only)\b", keywords))
            out.append((40, f"{label}-{version}", rf"(?:{name}){v}", keywords))
        out.append((20, label, rf"(?:{name})\b", keywords))
    for kind in CC_KINDS:
        words = r"[- ]".join(CC_WORDS[x] for x in kind.split("-"))
        for version in CC_VERSIONS:
            out.append((40, f"cc-{kind}-{version}", rf"\bcc[- ]{kind}[- ](?:v\.? ?)?{re.escape(version)}(?!\.?\d)", ("cc",)))
            out.append((40, f"cc-{kind}-{version}", rf"creative commons {words} {re.escape(version)}", ("creative commons",)))
            out.append((45, f"cc-{kind}-{version}", rf"creativecommons\.org/licenses/{kind}/{re.escape(version)}", ("creativecommons",)))
        out.append((25, f"cc-{kind}", rf"\bcc[- ]{kind}\b(?!-)", ("cc",)))
        out.append((25, f"cc-{kind}", rf"creative commons {words}\b", ("creative commons",)))
    out += [(30, label, pattern, (keyword,)) for label, pattern, keyword in SINGLE + SENTENCES]
    out += [(30, label, rf"\b{re.escape(name)} licen[cs]e", (f"{name} licen",)) for label, name in NAMED]
    out += [(60, x, rf"spdx-license-identifier:\s*{re.escape(x)}(?![\w.-])", ("spdx",)) for x in SPDX_PLAIN]
    for label, _, _, versions in FAMILIES:
        for version in versions:
            out += [(60, f"{label}-{version}{tail}", rf"spdx-license-identifier:\s*{label}-{re.escape(version)}(?:\.0)?{mark}(?![\w.-])", ("spdx",)) for tail, mark in (("", ""), ("-only", "-only"), ("-or-later", r"(?:-or-later|\+)"))]
    return sorted(out, key=lambda x: -x[0])


def _automaton(words: dict[str, object]):
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    out.make_automaton()
    return out


@lru_cache(1)
def _compiled():
    """The rules, the automaton of keywords with the numbers of the rules they open, and that of the keywords' first words."""
    found = [(priority, label, re.compile(pattern)) for priority, label, pattern, _ in rules()]
    opened: dict[str, list[int]] = {}
    for i, (*_, keywords) in enumerate(rules()):
        for keyword in keywords:
            opened.setdefault(keyword, []).append(i)
    return found, _automaton(opened), _automaton({k.split()[0]: True for k in opened})


#: Comment marks where a line begins or ends.
_MARKS = re.compile(r"^[ \t]*+(?:[*#;%>|!]++|//++|/\*++|--++|(?:dnl|rem)\b)|(?<![ \t])[ \t]++[*#|]++(?=[ \t]*+\r?$)", re.M)
_SOLID = re.compile(r"\S+")


def _unmarked(text: str) -> str:
    """The text with spaces for its comment marks; places stay as they are."""
    return _MARKS.sub(lambda m: " " * len(m[0]), text) if "\n" in text else text


def uncontained(hits: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int, int]]:
    """(label, priority, start, end) of the hits that lie in no accepted one of the same or a higher priority.

    Accepted intervals of higher priorities are kept by start with the furthest end so far, so a hit takes one search.
    """
    kept: list[tuple[str, int, int, int]] = []
    starts: list[int] = []
    furthest: list[int] = []
    for priority, group in groupby(sorted(hits, key=lambda x: (-x[0], x[1], -x[2])), key=lambda x: x[0]):
        reach, before = -1, len(kept)
        for _, start, end, label in group:
            k = bisect_right(starts, start)
            if reach < end and not (k and furthest[k - 1] >= end):
                kept.append((label, priority, start, end))
                reach = end
        if len(kept) > before:
            spans = sorted((start, end) for _, _, start, end in kept)
            starts, furthest = [x[0] for x in spans], [*accumulate((x[1] for x in spans), max)]
    return kept


def detect(text: str) -> list[tuple[str, int, int, int]]:
    """(label, priority, start, end) of the detections that stand in an ``str.lower``-free ASCII-lowered text."""
    found, keywords, firsts_of = _compiled()
    if next(firsts_of.iter(text), None) is None:  # many texts stop here
        return []
    plain = _unmarked(text)
    folded = " ".join(plain.split())
    opened = sorted(set().union(*{id(x): x for _, x in keywords.iter(folded)}.values()))
    if not opened:
        return []
    kept = uncontained([(found[i][0], m.start(), m.end(), found[i][1]) for i in opened for m in found[i][2].finditer(folded)])
    if not kept:
        return []
    # a place in the folded text lies as far into its word as in the text
    spans = [m.span() for m in _SOLID.finditer(plain)]
    firsts = list(accumulate((e - s + 1 for s, e in spans[:-1]), initial=0))

    def place(at: int) -> int:
        k = bisect_right(firsts, at) - 1
        return spans[k][0] + at - firsts[k]

    return sorted(((label, priority, place(start), place(end - 1) + 1) for label, priority, start, end in kept), key=lambda x: x[2])


_ASCII_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Lower-cases A-Z and turns every byte outside words into a space (48-57, a-z and all non-ASCII bytes stay).
_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if 48 <= i <= 57 or 97 <= i <= 122 or 65 <= i <= 90 or i >= 128 else 32 for i in range(256))
_BASE_BYTES = [(f" {phrase} ".encode(), label) for phrase, label in BASE.items()]


def scan(text: bytes) -> dict:
    """Words, base places and labels of one UTF-8 text."""
    words = text.translate(_WORDS).split()
    places: list[tuple[int, str]] = []
    joined = b""
    if any(x in text.translate(_ASCII_LOWER) for x in (b"license", b"by")):
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in _BASE_BYTES:
            at, word, counted = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                places.append((word, label))
                at = joined.find(phrase, at + 1)
    hits = detect(text.translate(_ASCII_LOWER).decode("utf-8", "replace"))
    base = {label for _, label in places}
    covered = max((priority for _, priority, _, _ in hits), default=0)
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min((p for p, _ in places), default=None), "last_word": max((p for p, _ in places), default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in hits})),
        "score": min(1.0, max(covered / 60, 0.5 if places else 0.0)), "n_detected": len(hits),
    }


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_detected bigint"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document; see the module's docstring for nulls, ties and repeated rows."""

    def run(batches):
        for b in batches:
            found = [scan(x) for x in byte_lists(b.column(1))]
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            columns = {k: pa.array([x[k] for x in found], kinds.get(k, pa.int64())) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detected")}
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns.values()], ["doc_id", *columns])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
