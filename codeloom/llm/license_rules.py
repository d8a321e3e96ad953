"""Signature rules for license scans, in order: of equal intervals the earlier rule wins.

A rule is `label | keyword | rest`: its regular expression is the keyword, which is literal, and then the rest. Both are
written for words of lower-case letters and digits with single spaces between them, as scans see texts; `+` joins the rest
without a space. A section gives priority and confidence to the rules below it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TABLE = r"""
# 3 1.0  sentences of license texts
mit | permission is hereby granted free of charge | to any person obtaining a copy of this software and associated documentation files
mit | the software is provided as is without warranty of any kind | express or implied including but not limited to
mit | the above copyright notice and this permission notice | shall be included in all copies or substantial portions
isc | permission to use copy modify and or distribute this software | for any purpose with or without fee is hereby granted
0bsd | permission to use copy modify and or distribute this software | for any purpose with or without fee is hereby granted the software
isc | permission to use copy modify and distribute this software | and its documentation for any purpose
bsd-2 | redistributions of source code must retain | (?:the )?above copyright notice this list of conditions and the following disclaimer
bsd | redistribution and use in source and binary forms | with or without modification are permitted
bsd-2 | redistributions in binary form must reproduce | (?:the )?above copyright notice
bsd-3 | neither the name of | (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|any|the) contributors
bsd-3 | the names of its contributors may not be used | to endorse or promote products
bsd-4 | all advertising materials mentioning features | or use of this software must display
apache-2 | you may not use this file except in compliance with the license | you may obtain a copy of the license at
apache-2 | distributed under the license is distributed on an as is basis | without warranties or conditions of any kind
apache-2 | http www apache org licenses license 2 0 |
apache-2 | https www apache org licenses license 2 0 |
apache-1.1 | this product includes software developed by the apache software foundation |
gpl | this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the gnu general public license |
lgpl | this library is free software | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | you should have received a copy of the gnu lesser general public license |
lgpl | you should have received a copy of the gnu library general public license |
agpl | you should have received a copy of the gnu affero general public license |
mpl-2 | this source code form is subject to the terms | of the mozilla public license v 2 0
mpl-2 | if a copy of the mpl was not distributed with this file | you can obtain one at
mpl-1.1 | the contents of this file are subject to the mozilla public license | version 1 1
epl | this program and the accompanying materials are made available under the terms | of the eclipse public license
zlib | this software is provided as is without any express or implied warranty | in no event will the authors be held liable
zlib | altered source versions must be plainly marked | as such
boost-1 | boost software license version 1 0 | 17th august 2003
unlicense | this is free and unencumbered software released into the public domain |
wtfpl | do what the fuck you want to public license |
wtfpl | you just do what the fuck you want to |
cc0 | to the extent possible under law | (?:the )?(?:[^ ]+ ){1,8}waived all copyright and related or neighboring rights
ofl | this font software is licensed under the sil open font license |
artistic | the intent of this document is to state the conditions | under which a package may be copied
json | the software shall be used for good not evil |
beerware | this stuff is worth it you can buy me a beer in return |
proprietary | this software is the confidential and proprietary information of |
proprietary | unauthorized copying of this file via any medium is strictly prohibited |
mit | permission is hereby granted without written agreement | and without license or royalty fees
python | this license agreement is between the python software foundation |
openssl | this product includes software developed by the openssl project |
busl | the licensor hereby grants you the right to copy modify create derivative works | redistribute and make non production use
sspl | if you make the functionality of the program | or a modified version available to third parties as a service
elastic | you may not provide the software to third parties as a hosted or managed service |
ofl | the fonts and derivatives however cannot be released under any other type of license |
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files |
x11 | except as contained in this notice the name of the x consortium | shall not be used

# 2 0.9  notices and full names
gpl-3-or-later | gnu general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?(?: of the license)? or (?:at your option )?any later
gpl-2-or-later | gnu general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?(?: of the license)? or (?:at your option )?any later
gpl-3 | gnu general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
gpl-2 | gnu general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)?
gpl-1 | gnu general public license | (?:version |v ?)1(?: 0)?
gpl-3-with-exception | gnu general public license | (?:version |v ?)?3(?: 0)? with (?:the )?(?:gcc runtime library|classpath|font) exception
gpl-2-with-exception | gnu general public license | (?:version |v ?)?2(?: 0)? with (?:the )?(?:classpath|font|linking) exception
lgpl-3 | gnu lesser general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
lgpl-2.1 | gnu lesser general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2 1
lgpl-2 | gnu library general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?2(?: 0)?
agpl-3 | gnu affero general public license | (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?3(?: 0)?
gfdl-1.3 | gnu free documentation license | (?:version |v ?)?1 3
gfdl-1.2 | gnu free documentation license | (?:version |v ?)?1 2
gfdl-1.1 | gnu free documentation license | (?:version |v ?)?1 1
apache-2 | apache license | (?:version |v ?)?2(?: 0)?
apache-2 | apache software license | (?:version |v ?)?2(?: 0)?
apache-1.1 | apache software license | (?:version |v ?)?1 1
apache-1.1 | apache license | (?:version |v ?)?1 1
apache-1 | apache software license | (?:version |v ?)?1 0
mit | licensed under the mit license |
mit | released under the mit license |
mit | distributed under the mit license |
mit | available under the mit license |
mit | subject to the mit license |
mit | the mit license mit |
bsd-3 | bsd 3 clause | (?:new |revised )?licen[cs]e
bsd-2 | bsd 2 clause | (?:simplified )?licen[cs]e
bsd-4 | bsd 4 clause | (?:original )?licen[cs]e
bsd-1 | bsd 1 clause | licen[cs]e
0bsd | bsd zero clause | licen[cs]e
bsd-3 | 3 clause bsd | licen[cs]e
bsd-2 | 2 clause bsd | licen[cs]e
bsd-4 | 4 clause bsd | licen[cs]e
bsd-3 | three clause bsd | licen[cs]e
bsd-2 | two clause bsd | licen[cs]e
bsd-3 | new bsd license |
bsd-3 | modified bsd license |
bsd-3 | revised bsd license |
bsd-2 | simplified bsd license |
bsd-2 | freebsd license |
bsd-4 | original bsd license |
bsd | licensed under the bsd license |
bsd | released under the bsd license |
mpl-2 | mozilla public license | (?:version |v ?)?2(?: 0)?
mpl-1.1 | mozilla public license | (?:version |v ?)?1 1
mpl-1 | mozilla public license | (?:version |v ?)?1 0
epl-2 | eclipse public license | (?:version |v ?)?2(?: 0)?
epl-1 | eclipse public license | (?:version |v ?)?1(?: 0)?
edl-1 | eclipse distribution license | (?:version |v ?)?1(?: 0)?
cddl-1.1 | common development and distribution license | (?:version |v ?)?1 1
cddl-1 | common development and distribution license | (?:version |v ?)?1(?: 0)?
cpl-1 | common public license | (?:version |v ?)?1(?: 0)?
eupl-1.2 | european union public licence | (?:version |v ?)?1 2
eupl-1.1 | european union public licence | (?:version |v ?)?1 1
artistic-2 | artistic license | (?:version |v ?)?2(?: 0)?
artistic-1 | artistic license | (?:version |v ?)?1(?: 0)?
afl-3 | academic free license | (?:version |v ?)?3(?: 0)?
afl-2.1 | academic free license | (?:version |v ?)?2 1
osl-3 | open software license | (?:version |v ?)?3(?: 0)?
osl-2.1 | open software license | (?:version |v ?)?2 1
boost-1 | boost software license | (?:version |v ?)?1(?: 0)?
python-2 | python software foundation license | (?:version |v ?)?2(?: 0)?
php-3.01 | php license | (?:version |v ?)?3 01
php-3 | php license | (?:version |v ?)?3(?: 0)?
ms-pl | microsoft public license | (?:ms pl)?
ms-rl | microsoft reciprocal license | (?:ms rl)?
ofl-1.1 | sil open font license | (?:version |v ?)?1 1
ofl-1 | sil open font license | (?:version |v ?)?1 0
lppl-1.3 | latex project public license | (?:version |v ?)?1 3[abc]?
upl-1 | universal permissive license | (?:version |v ?)?1(?: 0)?
ncsa | university of illinois ncsa open source license |
cecill-2.1 | cecill free software license agreement | (?:version |v ?)?2 1
cecill-b | cecill b free software license agreement |
cecill-c | cecill c free software license agreement |
busl-1.1 | business source license | (?:version |v ?)?1 1
sspl-1 | server side public license | (?:version |v ?)?1(?: 0)?
elastic-2 | elastic license | (?:version |v ?)?2(?: 0)?
polyform-nc | polyform noncommercial license | (?:1 0 0)?
polyform-sb | polyform small business license | (?:1 0 0)?
polyform-shield | polyform shield license | (?:1 0 0)?
commons-clause | commons clause license condition | (?:version |v ?)?1(?: 0)?
cc-by-nc-sa | creative commons attribution noncommercial sharealike | {cc}
cc-by-nc-sa | creative commons attribution non commercial share alike | {cc}
cc-by-nc-nd | creative commons attribution noncommercial noderivatives | {cc}
cc-by-nc-nd | creative commons attribution noncommercial noderivs | {cc}
cc-by-nc | creative commons attribution noncommercial | {cc}
cc-by-nc | creative commons attribution non commercial | {cc}
cc-by-sa | creative commons attribution sharealike | {cc}
cc-by-sa | creative commons attribution share alike | {cc}
cc-by-nd | creative commons attribution noderivatives | {cc}
cc-by-nd | creative commons attribution noderivs | {cc}
cc-by-nd | creative commons attribution no derivatives | {cc}
cc-by | creative commons attribution | {cc}
cc0 | creative commons zero | +(?: v?1 0)?(?: universal)?
cc0 | creative commons cc0 | +(?: v?1 0)?(?: universal)?
cc-pdm | creative commons public domain mark | (?:1 0)?
cc-by-nc-sa | cc by nc sa | [1-4] [05]
cc-by-nc-nd | cc by nc nd | [1-4] [05]
cc-by-nc | cc by nc | [1-4] [05]
cc-by-sa | cc by sa | [1-4] [05]
cc-by-nd | cc by nd | [1-4] [05]
cc-by | cc by | [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | (?:[1-4] [05])?
cc-by-nc-nd | creativecommons org licenses by nc nd | (?:[1-4] [05])?
cc-by-nc | creativecommons org licenses by nc | (?:[1-4] [05])?
cc-by-sa | creativecommons org licenses by sa | (?:[1-4] [05])?
cc-by-nd | creativecommons org licenses by nd | (?:[1-4] [05])?
cc-by | creativecommons org licenses by | (?:[1-4] [05])?
cc0 | creativecommons org publicdomain zero | (?:1 0)?
odbl-1 | open database license | (?:version |v ?)?(?:1 0)?
odc-by-1 | open data commons attribution license | (?:version |v ?)?(?:1 0)?
pddl-1 | public domain dedication and license | (?:version |v ?)?(?:1 0)?
ogl-uk-3 | open government licence | (?:version |v ?)?3(?: 0)?
ogl-uk-2 | open government licence | (?:version |v ?)?2(?: 0)?
etalab-2 | licence ouverte | (?:version |v ?)?2(?: 0)?
cdla-permissive | community data license agreement | (?:permissive)(?: version)?(?: [12] 0)?
cdla-sharing | community data license agreement | (?:sharing)(?: version)?(?: 1 0)?
openrail-m | creative ml openrail m | (?:license)?
rail | responsible ai license |
llama | llama 2 community license agreement |
llama | llama 3 community license agreement |
gemma | gemma terms of use |
mit | spdx license identifier mit |
apache-2 | spdx license identifier apache 2 0 |
gpl-3-or-later | spdx license identifier gpl 3 0 or later |
gpl-3 | spdx license identifier gpl 3 0 | (?:only)?
gpl-2-or-later | spdx license identifier gpl 2 0 or later |
gpl-2 | spdx license identifier gpl 2 0 | (?:only)?
lgpl-3 | spdx license identifier lgpl 3 0 | (?:only|or later)?
lgpl-2.1 | spdx license identifier lgpl 2 1 | (?:only|or later)?
agpl-3 | spdx license identifier agpl 3 0 | (?:only|or later)?
bsd-3 | spdx license identifier bsd 3 clause |
bsd-2 | spdx license identifier bsd 2 clause |
mpl-2 | spdx license identifier mpl 2 0 |
isc | spdx license identifier isc |
zlib | spdx license identifier zlib |
boost-1 | spdx license identifier bsl 1 0 |
unlicense | spdx license identifier unlicense |
cc0 | spdx license identifier cc0 1 0 |
cc-by-nc | spdx license identifier cc by nc | [1-4] 0
cc-by-sa | spdx license identifier cc by sa | [1-4] 0
cc-by | spdx license identifier cc by | [1-4] 0
epl-2 | spdx license identifier epl 2 0 |
all-rights-reserved | copyright all rights reserved |
public-domain | released into the public domain |
public-domain | dedicated to the public domain |
public-domain | placed in the public domain |
public-domain | this work is in the public domain |

# 1 0.6  short names and mentions
gpl | gnu general public license |
gpl | gnu gpl |
gpl-3 | gnu gpl | (?:version |v ?)?3(?: 0)?
gpl-2 | gnu gpl | (?:version |v ?)?2(?: 0)?
gpl-3 | gplv3 |
gpl-2 | gplv2 |
gpl-3 | gpl v3 |
gpl-2 | gpl v2 |
gpl-3 | gpl 3 0 | (?:only)?
gpl-2 | gpl 2 0 | (?:only)?
gpl-3-or-later | gpl 3 0 or later |
gpl-2-or-later | gpl 2 0 or later |
gpl | gpl license |
lgpl | gnu lesser general public license |
lgpl | gnu library general public license |
lgpl | gnu lgpl |
lgpl-3 | lgplv3 |
lgpl-2.1 | lgplv2 1 |
lgpl-3 | lgpl 3 0 |
lgpl-2.1 | lgpl 2 1 |
agpl | gnu affero general public license |
agpl | gnu agpl |
agpl-3 | agplv3 |
agpl-3 | agpl 3 0 |
gfdl | gnu free documentation license |
mit | mit license |
mit | mit licence |
mit | mit licensed |
mit | mit x11 license |
mit | expat license |
x11 | x11 license |
apache | apache license |
apache | apache software license |
apache-2 | apache 2 0 |
apache-2 | asl 2 0 |
bsd | bsd license |
bsd | bsd licence |
bsd | bsd licensed |
bsd | bsd style license |
bsd-3 | bsd 3 clause |
bsd-2 | bsd 2 clause |
isc | isc license |
zlib | zlib license |
zlib | zlib libpng license |
libpng | libpng license |
mpl | mozilla public license |
mpl-2 | mpl 2 0 |
mpl-1.1 | mpl 1 1 |
epl | eclipse public license |
epl-2 | epl 2 0 |
epl-1 | epl 1 0 |
cddl | common development and distribution license |
cpl | common public license |
eupl | european union public licence |
artistic | artistic license |
boost-1 | boost software license |
unlicense | the unlicense |
unlicense | unlicense org |
wtfpl | wtfpl |
python | python software foundation license |
php | php license |
ofl | sil open font license |
ofl | open font license |
lppl | latex project public license |
cecill | cecill license |
busl | business source license |
sspl | server side public license |
elastic | elastic license |
openssl | openssl license |
ruby | ruby license |
vim | vim license |
cc-by-nc-sa | cc by nc sa |
cc-by-nc-nd | cc by nc nd |
cc-by-nc | cc by nc |
cc-by-sa | cc by sa |
cc-by-nd | cc by nd |
cc0 | cc0 1 0 | (?:universal)?
cc0 | cc0 license |
cc | creative commons license |
cc | creative commons licence |
odbl | odbl license |
ogl-uk | open government licence |
ogl-ca | open government licence canada |
etalab | licence ouverte |
dual | dual licensed under |
proprietary | proprietary license |
proprietary | all rights reserved proprietary |
eula | end user license agreement |
shareware | shareware license |
public-domain | public domain dedication |
"""


class Rule(NamedTuple):
    ord: int
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    base: bool = False


def _read(table: str) -> list[Rule]:
    out, priority, confidence = [], 0, 0.0
    for line in filter(None, map(str.strip, table.splitlines())):
        if line[0] == "#":
            _, p, c, *_ = line.split()
            priority, confidence = int(p), float(c)
            continue
        label, keyword, rest = (x.strip(" |") for x in (line + " ").split(" | ", 2))
        rest = rest.replace("{cc}", "+(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: licen[cs]e)?")
        if rest and rest[0] != "+":  # after a space, which goes where all of it may be left out
            rest = f"(?: {rest})?" if re.fullmatch(rest, "") else f" {rest}" if "|" not in re.sub(r"\(.*?\)", "", rest) else f" (?:{rest})"
        out.append(Rule(len(out), label, keyword, keyword + rest.lstrip("+"), priority, confidence))
    return out


RULES = _read(_TABLE)
