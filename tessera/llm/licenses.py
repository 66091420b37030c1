"""License scan by ordered signature rules.

``rules()`` crosses license names with notice forms (grant, heading, identifier,
address) into some hundreds of patterns over the folded words of a text. One of
a rule's keywords must occur before it runs (prefilter); they are read off the
pattern, which can't match without one of them. Of overlapping detections
the one of higher priority, then the longer, then the earlier stays; one whose
words lie inside a kept one's is suppressed (interval containment).

Words: A-Z to lower case, then runs of anything but ASCII non-alphanumerics.

Defined results: null text is empty (no words, null places, empty labels, score
0); texts are scanned whole; repeated rows each get their row; other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from tessera.llm.common import small_batches, text_of

# fixed values: the contract's phrases and their labels
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Names as folded words (a pattern), label. Hand-written; the notice forms below
# turn each into several rules.
NAMES = [
    (r"mit(?: x11)?", "mit"), (r"x11", "x11"), (r"mit 0|mit no attribution", "mit-0"),
    (r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache-2"),
    (r"apache(?: software)?(?: license)?(?: version)? 1 1", "apache-1.1"),
    (r"(?:the )?(?:new |modified |revised |3 clause |three clause )bsd(?: 3 clause)?|bsd 3 clause", "bsd-3-clause"),
    (r"(?:simplified |2 clause |two clause |freebsd )bsd|bsd 2 clause", "bsd-2-clause"),
    (r"(?:4 clause |original )bsd|bsd 4 clause", "bsd-4-clause"), (r"bsd style|bsd", "bsd"), (r"0bsd|bsd zero clause", "0bsd"),
    (r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?|(?:gnu )?agpl ?v?3(?: 0)?", "agpl-3"),
    (r"(?:gnu )?affero general public license|(?:gnu )?agpl", "agpl"),
    (r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?|(?:gnu )?lgpl ?v?3(?: 0)?", "lgpl-3"),
    (r"(?:gnu )?lesser general public license(?: version| v)? ?2 1|(?:gnu )?lgpl ?v?2 1", "lgpl-2.1"),
    (r"(?:gnu )?(?:lesser|library) general public license|(?:gnu )?lgpl", "lgpl"),
    (r"(?:gnu )?general public license(?: version| v)? ?3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)?", "gpl-3"),
    (r"(?:gnu )?general public license(?: version| v)? ?2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)?", "gpl-2"),
    (r"(?:gnu )?general public license|(?:gnu )?gpl", "gpl"), (r"gnu free documentation license|gfdl", "gfdl"),
    (r"mozilla public license(?: version| v)? ?2(?: 0)?|mpl ?2(?: 0)?", "mpl-2"), (r"mozilla public license|mpl", "mpl"),
    (r"eclipse public license(?: version| v)? ?2(?: 0)?|epl 2(?: 0)?", "epl-2"), (r"eclipse public license|epl", "epl"),
    (r"common development and distribution license|cddl", "cddl"), (r"common public license|cpl 1 0", "cpl"),
    (r"creative commons zero|cc0(?: 1 0)?", "cc0"),
    (r"(?:creative commons|cc) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [234] [05])?", "cc-by-nc-sa"),
    (r"(?:creative commons|cc) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?derivatives)(?: [234] [05])?", "cc-by-nc-nd"),
    (r"(?:creative commons|cc) (?:by|attribution) (?:nc|non ?commercial)(?: [234] [05])?", "cc-by-nc"),
    (r"(?:creative commons|cc) (?:by|attribution) (?:sa|share ?alike)(?: [234] [05])?", "cc-by-sa"),
    (r"(?:creative commons|cc) (?:by|attribution) (?:nd|no ?derivatives)(?: [234] [05])?", "cc-by-nd"),
    (r"(?:creative commons|cc) (?:by|attribution)(?: [234] [05])?", "cc-by"),
    (r"isc", "isc"), (r"zlib(?: libpng)?", "zlib"), (r"boost software license(?: version)?(?: 1 0)?|bsl 1 0", "bsl-1"),
    (r"artistic license(?: version)? 2(?: 0)?", "artistic-2"), (r"artistic license", "artistic"),
    (r"unlicense", "unlicense"), (r"wtfpl|do what the f\w+ you want to public license", "wtfpl"),
    (r"python software foundation license|psf", "psf"), (r"postgresql license", "postgresql"),
    (r"open software license(?: version)?(?: 3(?: 0)?)?|osl 3 0", "osl"), (r"academic free license|afl 3 0", "afl"),
    (r"european union public licen[cs]e|eupl", "eupl"), (r"open data commons(?: open database license)?|odbl", "odbl"),
    (r"sil open font license|ofl(?: 1 1)?", "ofl"), (r"microsoft public license|ms pl", "ms-pl"),
    (r"business source license|busl", "busl"), (r"server side public license|sspl", "sspl"),
    (r"elastic license(?: 2 0)?", "elastic"), (r"commons clause", "commons-clause"),
    (r"beerware", "beerware"), (r"vim license", "vim"), (r"ruby license", "ruby"), (r"php license", "php"),
]
# notice forms: priority, confidence, pattern around the name
FORMS = [
    (5, 1.0, r"spdx license identifier (?:{})"),
    (4, 0.95, r"(?:licensed|released|distributed|available|published|provided|covered) (?:\w+ ){{0,3}}?(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{})(?: licen[cs]e)?"),
    (3, 0.9, r"(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{}) licen[cs]e"),
    (3, 0.9, r"under the terms of (?:the )?(?:{})"),
    (2, 0.8, r"(?:{}) licen[cs]e"),
    (2, 0.8, r"licen[cs]e (?:is |type )?(?:{})"),
    (1, 0.6, r"(?:{})"),
]
# signatures by hand: openings, obligations, disclaimers and file headers of license
# texts, and proprietary notices: pattern over folded words, label, priority, confidence
TEXTS = [
    (r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, 1.0),
    (r"permission to use copy modify and or distribute this software for any purpose", "isc", 6, 1.0),
    (r"redistribution and use in source and binary forms with or without modification", "bsd", 6, 0.9),
    (r"this is free and unencumbered software released into the public domain", "unlicense", 6, 1.0),
    (r"released into the public domain|dedicated to the public domain", "public-domain", 4, 0.8),
    (r"all rights reserved", "all-rights-reserved", 1, 0.5),
    (r"proprietary and confidential|confidential and proprietary", "proprietary", 2, 0.7),
    # MIT and its kin
    (r"to deal in the software without restriction including without limitation the rights", "mit", 6, 0.95),
    (r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions", "mit", 6, 0.95),
    (r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit", 3, 0.5),
    (r"the software shall be used for good not evil", "json", 7, 1.0),
    (r"except as contained in this notice the name of the x consortium shall not be used", "x11", 7, 1.0),
    (r"without the requirement to include the above copyright notice", "mit-0", 5, 0.6),
    (r"this software is furnished under license and may be used and copied only in accordance", "proprietary", 5, 0.7),
    (r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee", "hpnd", 6, 0.9),
    (r"in no event shall the university of california be liable to any party for direct indirect special", "postgresql", 6, 0.8),
    (r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "postgresql", 7, 1.0),
    # BSD
    (r"redistributions of source code must retain the above copyright notice this list of conditions", "bsd", 5, 0.9),
    (r"redistributions in binary form must reproduce the above copyright notice this list of conditions", "bsd", 5, 0.9),
    (r"neither the name of (?:the )?(?:\w+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote", "bsd-3-clause", 7, 1.0),
    (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "bsd-4-clause", 7, 1.0),
    (r"the views and conclusions contained in the software and documentation are those of the authors", "bsd-2-clause", 7, 0.9),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "0bsd", 5, 0.6),
    (r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 7, 1.0),
    (r"this product includes cryptographic software written by eric young", "ssleay", 7, 1.0),
    (r"redistributions in any form must be accompanied by information on how to obtain complete source code", "sleepycat", 7, 1.0),
    (r"university of illinois ncsa open source license", "ncsa", 7, 1.0),
    (r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", "ncsa", 6, 0.9),
    # Apache
    (r"you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", 6, 0.95),
    (r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2", 6, 0.9),
    (r"terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms", "apache-2", 7, 1.0),
    (r"www apache org licenses license 2 0", "apache-2", 6, 1.0),
    (r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2", 6, 0.9),
    (r"this product includes software developed by the apache software foundation", "apache-1.1", 5, 0.8),
    # GNU
    (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 6, 1.0),
    (r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", 7, 1.0),
    (r"you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl", 7, 1.0),
    (r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2-or-later", 8, 1.0),
    (r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3-or-later", 8, 1.0),
    (r"gnu general public license version 2 as published by the free software foundation", "gpl-2", 8, 1.0),
    (r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "lgpl-2.1-or-later", 8, 1.0),
    (r"gnu lesser general public license as published by the free software foundation either version 3 of the license", "lgpl-3-or-later", 8, 1.0),
    (r"the licenses for most software are designed to take away your freedom to share and change it", "gpl-2", 7, 1.0),
    (r"the gnu general public license is a free copyleft license for software and other kinds of works", "gpl-3", 7, 1.0),
    (r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lgpl-3", 7, 1.0),
    (r"remote network interaction use with the gnu general public license", "agpl-3", 7, 1.0),
    (r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gnu", 5, 0.7),
    (r"you should have received a copy of the gnu general public license along with this program", "gpl", 5, 0.9),
    (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 7, 1.0),
    (r"as a special exception (?:\w+ ){1,14}link(?:ing)? (?:\w+ ){0,12}openssl", "gpl-openssl-exception", 8, 0.9),
    (r"as a special exception if you link this library with other files", "gpl-linking-exception", 8, 0.9),
    (r"subject to the classpath exception", "classpath-exception", 8, 0.9),
    # weak copyleft
    (r"this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 8, 1.0),
    (r"the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 8, 1.0),
    (r"covered software is provided under this license on an as is basis without warranty of any kind", "mpl-2", 6, 0.9),
    (r"the accompanying program is provided under the terms of this eclipse public license", "epl", 7, 1.0),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", 7, 1.0),
    (r"the accompanying program is provided under the terms of this common public license", "cpl", 7, 1.0),
    (r"the contents of this file are subject to the terms of the common development and distribution license", "cddl", 7, 1.0),
    (r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", "apsl", 7, 1.0),
    (r"the contents of this file are subject to the netscape public license", "npl", 7, 1.0),
    (r"the contents of this file are subject to the sun public license", "spl", 7, 1.0),
    (r"this file is part of (?:\w+ ){1,4}q public license|the q public license version 1 0", "qpl", 7, 0.9),
    (r"reciprocal public license(?: version)? 1 5", "rpl", 6, 0.9),
    (r"licen[cs]ed under the eupl", "eupl", 6, 1.0),
    (r"licen[cs]ed under the open software license version 3 0", "osl", 6, 1.0),
    (r"licen[cs]ed under the academic free license version (?:2 1|3 0)", "afl", 6, 1.0),
    (r"cecill (?:b |c )?free software license agreement", "cecill", 6, 0.9),
    (r"this license governs use of the accompanying software if you use the software you accept this license", "ms-pl", 6, 0.9),
    (r"microsoft reciprocal license|ms rl", "ms-rl", 6, 0.9),
    # permissive, others
    (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 6, 0.9),
    (r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "zlib", 6, 1.0),
    (r"altered source versions must be plainly marked as such and must not be misrepresented", "zlib", 6, 0.9),
    (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1", 7, 1.0),
    (r"www boost org license 1 0 txt", "bsl-1", 6, 1.0),
    (r"the intent of this document is to state the conditions under which a package may be copied", "artistic", 7, 1.0),
    (r"this license establishes the terms under which a given free software package may be copied modified distributed", "artistic-2", 7, 1.0),
    (r"you just do what the f\w+ you want to", "wtfpl", 6, 1.0),
    (r"anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 6, 1.0),
    (r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beerware", 7, 1.0),
    (r"this license agreement is between the python software foundation", "psf", 7, 1.0),
    (r"this license agreement is between the corporation for national research initiatives", "cnri-python", 7, 1.0),
    (r"this product includes php software freely available from", "php", 7, 1.0),
    (r"you may redistribute (?:\w+ ){0,8}under either the terms of the 2 clause bsdl", "ruby", 7, 0.9),
    (r"vim is charityware", "vim", 7, 1.0),
    (r"this software is copyrighted by the regents of the university of california sun microsystems inc scriptics corporation", "tcl", 7, 1.0),
    (r"this software is based in part on the work of the independent jpeg group", "ijg", 7, 1.0),
    (r"portions of this software are copyright (?:\w+ ){0,4}the freetype project", "ftl", 7, 1.0),
    (r"the png reference library is supplied as is", "libpng", 7, 1.0),
    (r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "isc", 6, 0.9),
    (r"copyright and permission notice copyright c (?:\d+ )?(?:\w+ ){0,8}unicode inc", "unicode", 7, 0.9),
    (r"unicode inc license agreement data files and software", "unicode", 7, 1.0),
    (r"w3c software (?:and document )?notice and license", "w3c", 7, 1.0),
    (r"zope public license zpl", "zpl", 6, 1.0),
    (r"historical permission notice and disclaimer", "hpnd", 6, 1.0),
    (r"eiffel forum license version 2", "efl-2", 6, 1.0),
    (r"this font software is licensed under the sil open font license", "ofl", 7, 1.0),
    (r"the font software may be sold as part of a larger software package", "bitstream-vera", 7, 0.9),
    (r"ubuntu font licen[cs]e version 1 0", "ufl", 6, 1.0),
    (r"do not hold the author responsible for any damage|use it at your own risk", "as-is-notice", 1, 0.3),
    # content and data
    (r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0", 7, 1.0),
    (r"to the extent possible under law (?:\w+ ){1,8}has waived all copyright and related or neighboring rights", "cc0", 7, 1.0),
    (r"the work as defined below is provided under the terms of this creative commons public license", "cc", 6, 0.9),
    (r"you are free to share copy and redistribute the material in any medium or format", "cc", 5, 0.8),
    (r"you may not use the material for commercial purposes", "cc-nc-condition", 5, 0.8),
    (r"if you remix transform or build upon the material you may not distribute the modified material", "cc-nd-condition", 5, 0.8),
    (r"if you remix transform or build upon the material you must distribute your contributions under the same license", "cc-sa-condition", 5, 0.8),
    (r"you must give appropriate credit provide a link to the license and indicate if changes were made", "cc-by-condition", 5, 0.8),
    (r"creativecommons org publicdomain zero 1 0", "cc0", 7, 1.0),
    (r"creativecommons org licenses by nc sa (?:1 0|2 0|2 5|3 0|4 0)", "cc-by-nc-sa", 7, 1.0),
    (r"creativecommons org licenses by nc nd (?:1 0|2 0|2 5|3 0|4 0)", "cc-by-nc-nd", 7, 1.0),
    (r"creativecommons org licenses by nc (?:1 0|2 0|2 5|3 0|4 0)", "cc-by-nc", 7, 1.0),
    (r"creativecommons org licenses by sa (?:1 0|2 0|2 5|3 0|4 0)", "cc-by-sa", 7, 1.0),
    (r"creativecommons org licenses by nd (?:1 0|2 0|2 5|3 0|4 0)", "cc-by-nd", 7, 1.0),
    (r"creativecommons org licenses by (?:1 0|2 0|2 5|3 0|4 0)", "cc-by", 7, 1.0),
    (r"this (?:\w+ )?database is made available under the open database license", "odbl", 7, 1.0),
    (r"open data commons public domain dedication and licen[cs]e|pddl", "pddl", 6, 0.9),
    (r"open data commons attribution licen[cs]e|odc by", "odc-by", 6, 0.9),
    (r"open government licen[cs]e v(?:ersion)? ?[123](?: 0)?", "ogl", 6, 0.9),
    (r"text is available under the creative commons attribution sharealike license", "cc-by-sa", 7, 1.0),
    # source available and proprietary
    (r"change date (?:\w+ ){0,6}change license", "busl", 7, 0.9),
    (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "busl", 7, 1.0),
    (r"if you make the functionality of the program or a modified version available to third parties as a service", "sspl", 7, 1.0),
    (r"you may not provide the software to third parties as a hosted or managed service", "elastic", 7, 1.0),
    (r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "commons-clause", 7, 1.0),
    (r"polyform (?:noncommercial|small business|shield|strict) license", "polyform", 6, 1.0),
    (r"prosperity public license", "prosperity", 6, 1.0),
    (r"hippocratic license", "hippocratic", 6, 1.0),
    (r"anti 996 license", "anti-996", 6, 1.0),
    (r"for (?:personal|academic|educational|research|evaluation) (?:and (?:personal|academic|educational|research|evaluation) )?use only", "limited-use", 3, 0.6),
    (r"not for commercial use|non commercial use only|noncommercial use only", "non-commercial", 3, 0.6),
    (r"may not be (?:reproduced|copied|distributed|transmitted)(?: (?:or|and) (?:reproduced|copied|distributed|transmitted|used))* (?:\w+ ){0,6}without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", "proprietary", 4, 0.8),
    (r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:or|and) (?:copying|use|reproduction|distribution))* (?:\w+ ){0,6}(?:is )?(?:strictly )?prohibited", "proprietary", 4, 0.8),
    (r"end user licen[cs]e agreement|eula", "eula", 3, 0.7),
    (r"you may not reverse engineer decompile or disassemble", "proprietary", 5, 0.9),
    (r"this software contains (?:confidential|proprietary) information|trade secrets? of", "proprietary", 3, 0.7),
    (r"subject to the terms of (?:a|the) (?:separate )?commercial licen[cs]e", "commercial", 4, 0.8),
    (r"dual licen[cs]ed under", "dual-license-notice", 3, 0.5),
    (r"you may choose (?:either|one of|any of) (?:\w+ ){0,6}licen[cs]es?", "license-choice", 3, 0.5),
    (r"see the (?:file )?(?:accompanying )?(?:license|licence|copying)(?: txt| md)?(?: file)? for (?:details|more information|the full)", "license-reference", 2, 0.4),
    (r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "fsf-all-permissive", 7, 1.0),
    (r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it", "fsf-unlimited", 7, 1.0),
    (r"this work is licensed under (?:a|the) creative commons", "cc", 4, 0.8),
]
# names too short to count without a license notice around them
BARE_NEEDS_NOTICE = {"mit", "x11", "bsd", "isc", "zlib", "psf", "epl", "mpl", "afl", "ofl", "vim", "ruby", "php", "ms-pl", "osl", "gpl", "lgpl", "agpl"}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


MOST_KEYWORDS = 16


def keywords(pattern: str) -> tuple[bytes, ...]:
    """Strings of which one occurs, with a blank before and after the text, in
    every text that ``pattern`` matches as whole words."""
    from re import _parser as parser

    def exact(item) -> set[str] | None:
        """All strings that the item matches, if they are few."""
        op, arg = str(item[0]), item[1]
        if op == "LITERAL":
            return {chr(arg)}
        if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(c) for _, c in arg}
        if op == "SUBPATTERN":
            return whole(arg[-1])
        if op == "BRANCH":
            parts = [whole(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op == "MAX_REPEAT" and arg[:2] == (0, 1):
            part = whole(arg[2])
            return None if part is None else part | {""}
        return None

    def whole(items) -> set[str] | None:
        out = {""}
        for item in items:
            part = exact(item)
            if part is None or len(out) * len(part) > MOST_KEYWORDS:
                return None
            out = {x + y for x in out for y in part}
        return out

    def needed(items) -> set[str]:
        """The best set of which each match has a member; {""} says nothing."""
        runs = [{""}]
        for item in items:
            op, arg = str(item[0]), item[1]
            part = exact(item)
            if part is not None and len(runs[-1]) * len(part) <= MOST_KEYWORDS:
                runs[-1] = {x + y for x in runs[-1] for y in part}
            elif part is not None:
                runs.append(part)
            else:
                if op == "SUBPATTERN":
                    runs.append(needed(arg[-1]))
                elif op == "BRANCH":
                    runs.append(set().union(*map(needed, arg[1])))
                runs.append({""})
        return max(runs, key=lambda r: min(map(len, r)))

    found = needed(parser.parse(f" (?:{pattern}) "))
    return tuple(sorted(k.encode() for k in found if not any(o != k and o in k for o in found)))


def rules() -> list[tuple[str, str, tuple[bytes, ...], int, float]]:
    """(pattern, label, keywords, priority, confidence), highest priority first."""
    out = [(pattern, label, keywords(pattern), priority, confidence) for pattern, label, priority, confidence in TEXTS]
    for name, label in NAMES:
        keys = keywords(name)                       # each form has the name as whole words
        for priority, confidence, form in FORMS:
            if priority > 1 or label not in BARE_NEEDS_NOTICE:
                out.append((form.format(name), label, keys, priority, confidence))
    for pattern, label in BASE:
        out.append((pattern, label, keywords(pattern), 3, 0.9))
    return sorted(out, key=lambda r: -r[3])


def compiled():
    bounded = lambda p: re.compile((rf"(?<![^ ])(?:{p})(?![^ ])").encode())
    return [(bounded(p), label, keys, prio, conf) for p, label, keys, prio, conf in rules()]


def scan(folded: bytes, table) -> list[tuple[int, int, str, float]]:
    """Kept detections of one folded text: (first byte, end byte, label, confidence)."""
    found = []
    padded = b" " + folded + b" "
    seen: dict[tuple[bytes, ...], bool] = {}     # rules of one name share their keywords
    for order, (pattern, label, keys, priority, confidence) in enumerate(table):
        if keys not in seen:
            seen[keys] = any(k in padded for k in keys)
        if seen[keys]:
            for m in pattern.finditer(folded):
                found.append((-priority, m.start() - m.end(), m.start(), order, m.end(), label, confidence))
    found.sort()
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []       # kept intervals never contain each other's starts and ends
    ends: list[int] = []
    for _, _, a, _, b, label, confidence in found:
        # the kept interval with the greatest start <= a has the greatest end of those
        i = bisect_left(starts, a + 1)
        if i and ends[i - 1] >= b:
            continue
        kept.append((a, b, label, confidence))
        starts.insert(i, a)
        ends.insert(i, max(b, ends[i - 1] if i else b))
        for j in range(i + 1, len(ends)):
            if ends[j] >= b:
                break
            ends[j] = b
    return sorted(kept)


def base_places(folded: bytes) -> list[tuple[int, str]]:
    """First bytes of all places of the contract's phrases."""
    out = []
    for phrase, label in BASE:
        p = phrase.encode()
        at = folded.find(p)
        while at >= 0:
            if (at == 0 or folded[at - 1] == 32) and folded[at + len(p):at + len(p) + 1] in (b"", b" "):
                out.append((at, label))
            at = folded.find(p, at + 1)
    return sorted(out)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan_batches(batches):
    import pyarrow as pa

    table = compiled()
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            words = text.encode("utf-8", "replace").translate(_FOLD).split()
            folded = b" ".join(words)
            first = last = None
            base, kept = base_places(folded), scan(folded, table)
            if base:
                first, last = folded.count(b" ", 0, base[0][0]), folded.count(b" ", 0, base[-1][0])
            own = {label for _, label in base}
            miss = 1.0
            for _, _, _, confidence in kept:
                miss *= 1 - confidence
            row = (len(words), len(base), first, last, ",".join(sorted(own)),
                   ",".join(sorted(own | {label for _, _, label, _ in kept})), 1.0 if base else 1 - miss)
            for c, v in zip(cols, row):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id"] + names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The digest of op7, one row per document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_scan_batches, f"doc_id {kind}, {SCHEMA}")
