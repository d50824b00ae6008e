"""License scans: ordered signature rules behind a keyword prefilter.

Rules are hand-written patterns, one family after another, each with a label, a priority and the
keyword without which it can't match. One Aho-Corasick pass over the lower-cased text finds the
keywords that occur; only the rules that they open are run. Both read the text with every run of
whitespace folded to one blank, so that wrapped lines don't matter; places are those of the text. Of
the detections, one that lies inside the interval of another of higher priority (or of equal priority
and longer) is suppressed; of equal intervals with equal priority all stay. Identifiers after an SPDX
tag are read one by one and labelled like the names that they stand for.

Defined results: null and empty texts have no words, no places and score 0; repeated rows each give
a row; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspan.llm.common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD + "+")
#: Runs of whitespace other than one blank.
RUN = re.compile(r"\s{2,}|[^\S ]")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Fixed phrases of the base scan and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Versioned families: label stem, keyword, name pattern, versions. Each version has its rule, and
#: the family has one without a version.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)? licen[cs]e", ("1.0", "1.1", "2.0")),
    ("gpl", "general public", r"(?:gnu )?(?<!lesser )(?<!affero )general public licen[cs]e", ("1", "2", "3")),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e", ("2.1", "3")),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public", r"eclipse public licen[cs]e", ("1.0", "2.0")),
    ("eupl", "european union public", r"european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("cddl", "common development and distribution", r"common development and distribution licen[cs]e", ("1.0", "1.1")),
    ("cpl", "common public", r"common public licen[cs]e", ("1.0",)),
    ("osl", "open software", r"open software licen[cs]e", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", "academic free", r"academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", r"artistic licen[cs]e", ("1.0", "2.0")),
    ("bsl", "boost software", r"boost software licen[cs]e", ("1.0",)),
    ("busl", "business source", r"business source licen[cs]e", ("1.0", "1.1")),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[cs]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("ecl", "educational community", r"educational community licen[cs]e", ("1.0", "2.0")),
    ("efl", "eiffel forum", r"eiffel forum licen[cs]e", ("1.0", "2.0")),
    ("ipl", "ibm public", r"ibm public licen[cs]e", ("1.0",)),
    ("lppl", "latex project public", r"latex project public licen[cs]e", ("1.0", "1.1", "1.2", "1.3")),
    ("npl", "netscape public", r"netscape public licen[cs]e", ("1.0", "1.1")),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", ("1.0", "1.1")),
    ("php", "php license", r"php license", ("3.0", "3.01")),
    ("python", "python", r"python(?: software foundation)? licen[cs]e", ("2.0", "2.1")),
    ("qpl", "q public", r"q public licen[cs]e", ("1.0",)),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", ("1.1", "1.5")),
    ("spl", "sun public", r"sun public licen[cs]e", ("1.0",)),
    ("sspl", "server side public", r"server side public licen[cs]e", ("1",)),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", ("1.0",)),
    ("zpl", "zope public", r"zope public licen[cs]e", ("1.0", "1.1", "2.0", "2.1")),
    ("odbl", "database licen", r"open (?:data commons )?database licen[cs]e", ("1.0",)),
    ("mulan", "mulan", r"mulan (?:permissive|public) (?:software )?licen[cs]e", ("1", "2")),
)
#: Short names of the families that are written with a version, such as GPLv3, MPL-2.0 or Apache 2.0.
SHORT = ("apache", "gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "cddl", "osl", "afl", "artistic", "bsl", "busl", "cecill", "ecl", "efl", "lppl", "npl", "ofl", "php", "rpl", "sspl", "upl", "zpl", "odbl", "mulan")
#: SPDX identifiers of licences that have no family above, and their labels.
SPDX = {
    "mit": "mit", "mit-0": "mit-0", "isc": "isc", "zlib": "zlib", "libpng": "libpng", "unlicense": "unlicense", "wtfpl": "wtfpl", "0bsd": "0bsd", "bsd-1-clause": "bsd-1-clause",
    "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "bsd-4-clause": "bsd-4-clause", "bsd-2-clause-patent": "bsd-2-clause-patent", "bsd-3-clause-clear": "bsd-3-clause-clear",
    "cc0-1.0": "cc0", "ncsa": "ncsa", "openssl": "openssl", "postgresql": "postgresql", "curl": "curl", "vim": "vim", "x11": "x11", "elastic-2.0": "elastic-2.0", "beerware": "beerware", "bsl-1.0": "bsl-1.0",
    "python-2.0": "python-2.0", "psf-2.0": "python-2.0", "ruby": "ruby", "tcl": "tcl", "w3c": "w3c", "icu": "icu", "ftl": "ftl", "ijg": "ijg", "json": "json", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "hpnd": "hpnd",
    "blueoak-1.0.0": "blueoak-1.0.0", "afl-3.0": "afl-3.0", "unicode-dfs-2016": "unicode", "unicode-3.0": "unicode", "bzip2-1.0.6": "bzip2", "sleepycat": "sleepycat", "intel": "intel", "naumen": "naumen", "ntp": "ntp",
}
#: Creative Commons terms by short name and title.
CC_TERMS = (
    ("by-nc-sa", r"attribution[ -]noncommercial[ -]share ?alike"),
    ("by-nc-nd", r"attribution[ -]noncommercial[ -]no ?deriv\w*"),
    ("by-nc", r"attribution[ -]noncommercial"),
    ("by-sa", r"attribution[ -]share ?alike"),
    ("by-nd", r"attribution[ -]no ?deriv\w*"),
    ("by", r"attribution"),
)
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names, grants and notices that have no version.
SINGLE = (
    Rule("mit", 60, "mit licen", r"\bmit licen[cs]e\b"),
    Rule("mit", 90, "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    Rule("mit", 70, "licensed under the mit", r"licensed under the mit\b(?: licen[cs]e)?"),
    Rule("mit", 72, "the mit", r"distributed under the(?: terms of the)? mit\b(?: licen[cs]e)?"),
    Rule("mit", 72, "(mit)", r"licen[cs]e \(mit\)"),
    Rule("mit", 88, "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    Rule("mit", 74, "opensource.org/licenses/mit", r"opensource\.org/licenses/mit\b"),
    Rule("expat", 60, "expat", r"\bexpat licen[cs]e\b"),
    Rule("bsd", 55, "bsd", r"\bbsd licen[cs]e\b"),
    Rule("bsd", 58, "bsd-style", r"\bbsd-style licen[cs]e\b"),
    Rule("bsd", 58, "bsd style", r"\bbsd style licen[cs]e\b"),
    Rule("bsd-2-clause", 74, "opensource.org/licenses/bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    Rule("bsd-3-clause", 74, "opensource.org/licenses/bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    Rule("0bsd", 75, "zero-clause bsd", r"\bzero-clause bsd\b"),
    Rule("0bsd", 75, "0bsd", r"\b0bsd\b"),
    Rule("bsd", 70, "this software is provided by the copyright holders and contributors", r"this software is provided by the copyright holders and contributors [\"“'`]*as is[\"”']*"),
    Rule("bsd", 70, "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice"),
    Rule("bsd", 70, "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    Rule("isc", 74, "opensource.org/licenses/isc", r"opensource\.org/licenses/isc\b"),
    Rule("0bsd", 92, "permission to use, copy, modify, and", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.(?! provided)"),
    Rule("zlib", 85, "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such"),
    Rule("libpng", 60, "libpng", r"\blibpng licen[cs]e\b"),
    Rule("unlicense", 80, "unlicense.org", r"\bunlicense\.org\b"),
    Rule("wtfpl", 70, "wtfpl", r"\bwtfpl\b"),
    Rule("public-domain", 50, "public domain", r"(?:is|are) (?:hereby )?in the public domain"),
    Rule("public-domain", 55, "dedicate", r"dedicates? (?:any and all copyright interest|this work|the work) .{0,60}to the public domain"),
    Rule("cc0", 85, "cc0 1.0 universal", r"cc0 1\.0 universal"),
    Rule("cc0", 84, "waived all copyright", r"waived all copyright and related or neighbou?ring rights"),
    Rule("apache-2.0", 88, "apache license, version 2.0 (the", r"licensed under the apache licen[cs]e, version 2\.0 \(the [\"“]licen[cs]e[\"”]\)"),
    Rule("apache", 60, "asf", r"licensed to the apache software foundation \(asf\)"),
    Rule("apache-2.0", 82, "unless required by applicable law or agreed to in writing", r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an [\"“']as is[\"”'] basis"),
    Rule("apache-2.0", 74, "apache2", r"\bapache2(?:\.0)?\b"),
    Rule("apache-1.1", 85, "apache group", r"this product includes software developed by the apache group"),
    Rule("gpl", 70, "copy of the gnu general public", r"you should have received a copy of the gnu general public licen[cs]e"),
    Rule("lgpl", 70, "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    Rule("lgpl", 70, "copy of the gnu library", r"you should have received a copy of the gnu library general public licen[cs]e"),
    Rule("lgpl", 50, "library general public", r"\b(?:gnu )?library general public licen[cs]e"),
    Rule("lgpl-2", 75, "library general public", r"\b(?:gnu )?library general public licen[cs]e,? (?:version |v\.?)2(?:\.0)?(?![.\d])"),
    Rule("agpl", 70, "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    Rule("gpl-classpath-exception", 92, "classpath exception", r"classpath exception"),
    Rule("gpl-classpath-exception", 92, "linking this library statically or dynamically", r"linking this library statically or dynamically with other modules"),
    Rule("gcc-exception", 90, "gcc runtime library exception", r"gcc runtime library exception"),
    Rule("mpl-2.0", 90, "subject to the terms of the mozilla public", r"subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0"),
    Rule("mpl-1.1", 90, "subject to the mozilla public license version", r"subject to the mozilla public licen[cs]e version 1\.1"),
    Rule("mpl-2.0", 84, "incompatible with secondary licenses", r"incompatible with secondary licen[cs]es"),
    Rule("epl-2.0", 85, "eclipse.org/legal/epl-2.0", r"eclipse\.org/legal/epl-2\.0"),
    Rule("epl-1.0", 85, "eclipse.org/legal/epl-v10", r"eclipse\.org/legal/epl-v10"),
    Rule("cddl", 60, "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    Rule("bsl-1.0", 90, "permission is hereby granted, free of charge, to any person or organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    Rule("bsl-1.0", 85, "boost.org/license_1_0", r"boost\.org/license_1_0"),
    Rule("artistic", 60, "same terms as perl", r"under the same terms as perl itself"),
    Rule("artistic-2.0", 80, "perlfoundation.org/artistic_license_2_0", r"perlfoundation\.org/artistic_license_2_0"),
    Rule("ofl-1.1", 85, "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    Rule("ofl", 75, "reserved font name", r"with reserved font name"),
    Rule("python-2.0", 75, "psf license", r"\bpsf licen[cs]e\b"),
    Rule("ruby", 60, "ruby", r"\bruby(?:'s)? licen[cs]e\b"),
    Rule("tcl", 60, "tcl", r"\btcl/tk licen[cs]e\b"),
    Rule("w3c", 65, "w3c", r"\bw3c (?:software (?:notice and |and document )?)?licen[cs]e\b"),
    Rule("icu", 60, "icu licen", r"\bicu licen[cs]e\b"),
    Rule("ftl", 60, "freetype", r"\bfreetype (?:project )?licen[cs]e\b"),
    Rule("ijg", 65, "independent jpeg group", r"independent jpeg group"),
    Rule("json", 70, "good, not evil", r"the software shall be used for good, not evil"),
    Rule("ms-pl", 60, "microsoft public", r"\bmicrosoft public licen[cs]e\b"),
    Rule("ms-rl", 60, "microsoft reciprocal", r"\bmicrosoft reciprocal licen[cs]e\b"),
    Rule("hpnd", 60, "historical permission notice", r"historical permission notice and disclaimer"),
    Rule("unicode", 60, "unicode", r"\bunicode(?:, inc\.)? licen[cs]e\b"),
    Rule("bzip2", 60, "bzip2", r"\bbzip2 licen[cs]e\b"),
    Rule("sleepycat", 60, "sleepycat", r"\bsleepycat licen[cs]e\b"),
    Rule("blueoak-1.0.0", 70, "blue oak", r"blue oak model licen[cs]e(?: 1\.0\.0)?"),
    Rule("commons-clause", 80, "commons clause", r"\bcommons clause\b"),
    Rule("polyform-noncommercial", 75, "polyform", r"polyform noncommercial licen[cs]e"),
    Rule("polyform-shield", 75, "polyform", r"polyform shield licen[cs]e"),
    Rule("fsl", 70, "functional source", r"functional source licen[cs]e"),
    Rule("openrail", 65, "openrail", r"\b(?:creativeml )?open ?rail(?:-?\+?\+?m)?\b"),
    Rule("openrail", 65, "responsible ai", r"responsible ai licen[cs]e"),
    Rule("llama", 65, "llama", r"\bllama \d(?:\.\d)? community licen[cs]e"),
    Rule("odc-by", 70, "odc-by", r"\bodc-by\b"),
    Rule("odc-by", 70, "open data commons attribution", r"open data commons attribution licen[cs]e"),
    Rule("pddl", 70, "public domain dedication and licen", r"public domain dedication and licen[cs]e"),
    Rule("cdla-permissive", 70, "community data license agreement", r"community data license agreement\W+permissive"),
    Rule("cdla-sharing", 70, "community data license agreement", r"community data license agreement\W+sharing"),
    Rule("ogl", 65, "open government", r"open government licen[cs]e"),
    Rule("cern-ohl", 65, "cern open hardware", r"cern open hardware licen[cs]e"),
    Rule("solderpad", 65, "solderpad", r"solderpad hardware licen[cs]e"),
    Rule("proprietary", 45, "trade secret", r"contains (?:confidential and )?trade secrets? of"),
    Rule("proprietary", 45, "may not be reproduced", r"may not be reproduced (?:or distributed )?(?:in any form )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    Rule("proprietary", 48, "licensed material", r"licensed materials?\W+property of"),
    Rule("proprietary", 48, "for internal use only", r"for internal use only"),
    Rule("eula", 45, "end user license agreement", r"end user license agreement"),
    Rule("eula", 45, "end-user license agreement", r"end-user license agreement"),
    Rule("copyright", 20, "©", r"©\s*[12][0-9]{3}(?:\s*[-,]\s*[12][0-9]{3})*"),
    Rule("copyleft", 35, "copyleft", r"\bcopyleft\b"),
    Rule("bsd-2-clause", 75, "bsd", r"\b(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd)\b"),
    Rule("bsd-3-clause", 75, "bsd", r"\b(?:bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd)\b"),
    Rule("bsd-4-clause", 75, "bsd", r"\b(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)\b"),
    Rule("bsd", 90, "redistribution and use in source and binary", r"redistribution and use in source and binary forms,? with or without\s+modification"),
    Rule("bsd-3-clause", 95, "neither the name of", r"neither the name of [^.\n]{1,200}may be used to endorse or promote"),
    Rule("bsd-4-clause", 95, "all advertising materials", r"all advertising materials mentioning features or use of this software"),
    Rule("isc", 90, "permission to use, copy, modify, and", r"permission to use, copy, modify, and(?:/or)? distribute this software for any\s+purpose"),
    Rule("isc", 60, "isc licen", r"\bisc licen[cs]e\b"),
    Rule("zlib", 90, "provided 'as-is', without any express", r"this software is provided 'as-is', without any express or implied\s+warranty"),
    Rule("zlib", 60, "zlib", r"\bzlib(?:/libpng)? licen[cs]e\b"),
    Rule("unlicense", 90, "unencumbered software released into the public domain", r"free and unencumbered software released into the public domain"),
    Rule("unlicense", 60, "unlicense", r"\bthe unlicense\b"),
    Rule("wtfpl", 60, "do what the fuck you want", r"do what the fuck you want to public licen[cs]e"),
    Rule("public-domain", 50, "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    Rule("cc0", 80, "cc0", r"\bcc0(?:[ -]1\.0)?\b"),
    Rule("cc0", 80, "creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    Rule("apache-2.0", 90, "apache.org/licenses/license-2.0", r"apache\.org/licenses/license-2\.0"),
    Rule("gpl", 90, "free software; you can redistribute", r"free software; you can redistribute it and/or modify"),
    Rule("gpl", 90, "free software: you can redistribute", r"free software: you can redistribute it and/or modify"),
    Rule("gpl", 80, "gnu.org/licenses/gpl", r"gnu\.org/licenses/gpl[\w.-]*"),
    Rule("lgpl", 80, "gnu.org/licenses/lgpl", r"gnu\.org/licenses/lgpl[\w.-]*"),
    Rule("agpl", 80, "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl[\w.-]*"),
    Rule("mpl-2.0", 80, "mozilla.org/mpl/2.0", r"mozilla\.org/mpl/2\.0"),
    Rule("opensource", 40, "opensource.org/licenses", r"opensource\.org/licenses/[\w.-]+"),
    Rule("copyright", 20, "copyright", r"copyright\s+(?:\(c\)|©)?\s*[12][0-9]{3}(?:\s*[-,]\s*[12][0-9]{3})*"),
    Rule("reserved", 30, "some rights reserved", r"some rights reserved"),
    Rule("proprietary", 50, "proprietary", r"proprietary and confidential"),
    Rule("proprietary", 50, "copying of this", r"unauthori[sz]ed copying of this (?:file|work)"),
    Rule("beerware", 60, "beer-ware", r"the beer-ware licen[cs]e"),
    Rule("ncsa", 60, "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    Rule("openssl", 60, "openssl", r"\bopenssl licen[cs]e\b"),
    Rule("postgresql", 60, "postgresql", r"\bpostgresql licen[cs]e\b"),
    Rule("curl", 60, "curl licen", r"\bcurl licen[cs]e\b"),
    Rule("vim", 60, "vim licen", r"\bvim licen[cs]e\b"),
    Rule("x11", 60, "x11 licen", r"\bx11 licen[cs]e\b"),
    Rule("elastic-2.0", 75, "elastic licen", r"elastic licen[cs]e(?:,? (?:version )?2\.0)?"),
)


def rules() -> tuple[Rule, ...]:
    """All signature rules, highest priority first."""
    out = list(SINGLE)
    for stem, keyword, name, versions in FAMILIES:
        out.append(Rule(stem, 50, keyword, rf"\b{name}"))
        for v in versions:
            number = re.escape(v) + (r"(?:\.0)?" if "." not in v else "")
            out.append(Rule(f"{stem}-{v}", 70, keyword, rf"\b{name},?\s+(?:\(\w+\)\s*)?(?:as published by [^.\n]{{1,80}}[,;]\s+(?:either\s+)?)?(?:version\s+|v\.?\s*){number}(?![0-9.]*[0-9])"))
            out.append(Rule(f"{stem}-{v}-or-later", 80, keyword, rf"\b{name},?\s+(?:version\s+|v\.?\s*){number},? or (?:\(at your option\) )?(?:any )?later"))
        out.append(Rule(stem, 60, "licensed under", rf"licensed under (?:the )?(?:terms of (?:the )?)?{name}"))
        if stem in SHORT:
            for v in versions:
                number = re.escape(v.removesuffix(".0")) + r"(?:\.0)?"
                form = rf"\b{stem}(?:[ -]?v(?:ersion)?\.? ?|[ -]){number}"
                out.append(Rule(f"{stem}-{v}", 68, stem, form + r"(?![0-9.]*[0-9]|\+)"))
                out.append(Rule(f"{stem}-{v}-or-later", 78, stem, form + r"(?:\+|-or-later|,? or (?:\(at your option\) )?(?:any )?later)"))
        if "general public" in keyword:
            for v in versions:
                number = re.escape(v) + (r"(?:\.0)?" if "." not in v else "")
                grant = rf"\b{name},? as published by the free software foundation[,;:]? (?:either )?version {number}(?: of the licen[cs]e)?,?"
                out.append(Rule(f"{stem}-{v}-or-later", 96, keyword, grant + r" or \(at your option\) any later version"))
                out.append(Rule(f"{stem}-{v}-or-later", 82, keyword, rf"\bversion {number}(?: of the licen[cs]e)?,? or \(at your option\) any later version of the {name}"))
    for short, title in CC_TERMS:
        out.append(Rule(f"cc-{short}", 60, "creative commons", rf"creative commons\s+{title}"))
        out.append(Rule(f"cc-{short}", 55, f"cc {short}", rf"\bcc {short}(?![a-z-]*[a-z])"))
        out.append(Rule(f"cc-{short}", 55, f"cc-{short}", rf"\bcc-{short}(?![a-z-]*[a-z])"))
        for v in CC_VERSIONS:
            number = re.escape(v)
            out.append(Rule(f"cc-{short}-{v}", 80, "creative commons", rf"creative commons\s+{title}\s+(?:licen[cs]e\s+)?{number}"))
            out.append(Rule(f"cc-{short}-{v}", 75, f"cc {short}", rf"\bcc {short}[ -]{number}"))
            out.append(Rule(f"cc-{short}-{v}", 75, f"cc-{short}", rf"\bcc-{short}[ -]{number}"))
            out.append(Rule(f"cc-{short}-{v}", 85, "creativecommons.org/licenses", rf"creativecommons\.org/licenses/{short}/{number}"))
    out.append(Rule("spdx", 97, "spdx-license-identifier", r"spdx-license-identifier:\s*(?P<spdx>\(?[a-z0-9.+-]+(?:\)|\(|\s+(?:and|or|with)\s+\(?[a-z0-9.+-]+)*)"))
    return tuple(sorted(out, key=lambda r: -r.priority))


def spdx_label(identifier: str) -> str:
    """The label of an SPDX identifier; ``spdx`` where it is unknown."""
    if identifier in SPDX:
        return SPDX[identifier]
    name, later = identifier.removesuffix("-only"), identifier.endswith(("+", "-or-later"))
    name = name.removesuffix("+").removesuffix("-or-later")
    for stem, _, _, versions in FAMILIES:
        for v in versions:
            if name in (f"{stem}-{v}", f"{stem}-{v}.0"):
                return f"{stem}-{v}" + ("-or-later" if later else "")
    return name if re.fullmatch(r"cc-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.[05]", name) else "spdx"


def labels_of(match: re.Match, rule: Rule) -> list[Rule]:
    """What a match says: the rule's label, or one for each identifier of an SPDX expression."""
    expression = match.groupdict().get("spdx")
    if not expression:
        return [rule]
    # What follows a WITH is an exception, not a licence.
    names = re.findall(r"(?<![a-z0-9.+-])(?!(?:and|or|with)\b)[a-z0-9.+-]+", re.sub(r"\bwith\s+[a-z0-9.+-]+", "", expression))
    return [rule._replace(label=x) for x in sorted({spdx_label(n.strip(".-") if n not in SPDX else n) for n in names})]


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without detections inside another's interval of higher priority, or equal priority and length.

    Sorted by start and descending end; a sweep keeps, per priority, the furthest end so far. What
    came earlier and reaches as far is longer; equal intervals are taken together.
    """
    kept: list[tuple[int, int, Rule]] = []
    reach: dict[int, int] = {}
    for (start, end), same in groupby(sorted(set(found), key=lambda x: (x[0], -x[1], -x[2].priority, x[2].label)), key=lambda x: x[:2]):
        rules = [r for _, _, r in same]
        kept += [(start, end, r) for r in rules if r.priority == rules[0].priority and not any(e >= end for p, e in reach.items() if p >= r.priority)]
        for r in rules:
            reach[r.priority] = max(reach.get(r.priority, -1), end)
    return kept


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """The text with runs of whitespace as one blank; the places after them, and how much went so far."""
    parts, after, gone, at, shift, size = [], [], [], 0, 0, 0
    for m in RUN.finditer(text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        shift += m.end() - m.start() - 1
        at = m.end()
        after.append(size)
        gone.append(shift)
    return "".join([*parts, text[at:]]) if parts else text, after, gone


class LicenseScanner:
    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by.setdefault(rule.keyword, []).append(i)
        for keyword, which in by.items():
            self.automaton.add_word(keyword, which)
        self.automaton.make_automaton()
        self.base = [(re.compile(f"(?<!{WORD})" + SEP.join(p.split()) + f"(?!{WORD})"), label) for p, label in BASE]
        self.gates = [p.split()[1] if label == "cc-by" else p.split()[-1] for p, label in BASE]

    def opened(self, flat: str) -> set[int]:
        """The rules whose keyword is in the folded text."""
        return {i for _, which in self.automaton.iter(flat) for i in which}

    def detections(self, low: str, gate: bool = True) -> list[tuple[int, int, Rule]]:
        flat, after, gone = folded(low)
        place = lambda p: p + gone[k - 1] if (k := bisect_right(after, p)) else p
        found = []
        for i in self.opened(flat) if gate else range(len(self.rules)):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            found += [(place(m.start()), place(m.end() - 1) + 1, r) for m in self.compiled[i].finditer(flat) for r in labels_of(m, self.rules[i])]
        return suppressed(found)

    def row(self, text: str) -> dict:
        low = text.translate(UPPER) if not text.isascii() else text.lower()
        words = len(WORDS.findall(low))
        places = [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(low)]
        found = self.detections(low)
        starts = [m.start() for m in WORDS.finditer(low)] if places else []
        at = [bisect_right(starts, s) - 1 for s, _ in places]
        base = sorted({label for _, label in places})
        labels = sorted({*base, *(r.label for _, _, r in found)})
        best = max([*(r.priority for _, _, r in found), *(50 for _ in places)], default=0)
        return {
            "n_words": words,
            "n_base": len(places),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(labels),
            "score": best / 100.0,
            "detections": [{"start": s, "end": e, "label": r.label, "priority": r.priority} for s, e, r in found],
        }


ROW = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,detections:array<struct<start:long,end:long,label:string,priority:int>>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the base scan's figures, all labels, score and detections.

    ``score`` is the highest priority among the detections that stay, in hundredths.
    """

    @F.pandas_udf(ROW)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = LicenseScanner()
        names = [part.split(":")[0] for part in ROW[7:].split(",")[:7]] + ["detections"]
        for texts in batches:
            out = pd.DataFrame([scanner.row(t) for t in texts], columns=names)
            for name in ("first_word", "last_word"):
                out[name] = out[name].astype("Int64")
            yield out

    return docs.select(docs[id_col], scan(text_of(docs, text_col)).alias("r")).select(id_col, "r.*")


def license_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`scan_licenses` without the detections."""
    return scan_licenses(docs, id_col, text_col).drop("detections")
