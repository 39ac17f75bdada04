"""Signature rules of licenses: one line each, as label | tier | keyword | pattern.

A rule is tried only on texts that have each word of its keyword. Patterns are over lower-case words (ASCII letters and digits, and everything beyond ASCII) with one
blank between words, so "GPL-3.0" reads "gpl 3 0". {v} is an optional "version" or "v", {l} is license or licence, and " ?" is a gap that may be missing.
Tiers: 1 identifiers, 2 sentences of the license itself or of its header, 3 names with a version,
4 names, 5 hints. A lower tier is the higher priority; inside a tier the earlier rule is.
"""

TEXT = r"""
gpl-1.0|1|spdx|spdx {l} identifier gpl 1 0(?: only| or later)?
gpl-2.0-only|1|spdx|spdx {l} identifier gpl 2 0(?: only)?
gpl-2.0-or-later|1|spdx|spdx {l} identifier gpl 2 0 or later
gpl-3.0-only|1|spdx|spdx {l} identifier gpl 3 0(?: only)?
gpl-3.0-or-later|1|spdx|spdx {l} identifier gpl 3 0 or later
lgpl-2.0|1|spdx|spdx {l} identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|1|spdx|spdx {l} identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|1|spdx|spdx {l} identifier lgpl 3 0(?: only| or later)?
agpl-3.0|1|spdx|spdx {l} identifier agpl 3 0(?: only| or later)?
apache-2.0|1|spdx|spdx {l} identifier apache 2 0
mit|1|spdx|spdx {l} identifier mit
mit-0|1|spdx|spdx {l} identifier mit 0
bsd-2-clause|1|spdx|spdx {l} identifier bsd 2 clause
bsd-3-clause|1|spdx|spdx {l} identifier bsd 3 clause
0bsd|1|spdx|spdx {l} identifier 0bsd
isc|1|spdx|spdx {l} identifier isc
mpl-2.0|1|spdx|spdx {l} identifier mpl 2 0
epl-2.0|1|spdx|spdx {l} identifier epl 2 0
bsl-1.0|1|spdx|spdx {l} identifier bsl 1 0
busl-1.1|1|spdx|spdx {l} identifier busl 1 1
cc0-1.0|1|spdx|spdx {l} identifier cc0 1 0
cc-by-4.0|1|spdx|spdx {l} identifier cc by 4 0
cc-by-sa-4.0|1|spdx|spdx {l} identifier cc by sa 4 0
unlicense|1|spdx|spdx {l} identifier unlicense
zlib|1|spdx|spdx {l} identifier zlib
other-spdx|2|spdx|spdx {l} identifier [^ ]+
gpl-2.0-or-later|2|free software foundation|gnu general public {l} as published by the free software foundation (?:either )?{v}2(?: 0)? of the {l} or at your option any later version
gpl-3.0-or-later|2|free software foundation|gnu general public {l} as published by the free software foundation (?:either )?{v}3(?: 0)? of the {l} or at your option any later version
gpl-2.0-only|2|free software foundation|gnu general public {l} {v}2(?: 0)? (?:only )?as published by the free software foundation
gpl-3.0-only|2|free software foundation|gnu general public {l} {v}3(?: 0)? (?:only )?as published by the free software foundation
lgpl-2.1-or-later|2|free software foundation|gnu lesser general public {l} as published by the free software foundation (?:either )?{v}2 1 of the {l} or at your option any later version
lgpl-3.0-or-later|2|free software foundation|gnu lesser general public {l} as published by the free software foundation (?:either )?{v}3(?: 0)? of the {l} or at your option any later version
lgpl-2.0-or-later|2|free software foundation|gnu library general public {l} as published by the free software foundation (?:either )?{v}2(?: 0)? of the {l} or at your option any later version
agpl-3.0-or-later|2|free software foundation|gnu affero general public {l} as published by the free software foundation (?:either )?{v}3(?: 0)? of the {l} or at your option any later version
gpl|2|merchantability|this program is distributed in the hope that it will be useful but without any warranty
gpl|2|verbatim|everyone is permitted to copy and distribute verbatim copies of this {l} document but changing it is not allowed
gpl|2|freedom|the licenses for most software are designed to take away your freedom to share and change it
lgpl|2|library redistribute|this library is free software you can redistribute it and or modify it
gpl|2|redistribute|this program is free software you can redistribute it and or modify it
agpl-3.0|2|network server|specifically designed to ensure cooperation with the community in the case of network server software
apache-2.0|2|apache|licensed under the apache {l} {v}2(?: 0)? the {l} you may not use this file except in compliance with the {l}
apache-2.0|2|basis applicable|unless required by applicable law or agreed to in writing software distributed under the {l} is distributed on an as is basis
apache-1.1|2|apache|this product includes software developed by the apache software foundation
apache-1.0|2|apache|this product includes software developed by the apache group
mit|2|granted charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|2|substantial portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|2|merchantability|the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11|2|x consortium|the name of the x consortium shall not be used in advertising
ncsa|2|names contributors|neither the names of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause|2|redistribution|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|2|endorse|neither the name of [^ ]+(?: [^ ]+){0,12} may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|2|advertising|all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd|2|contributors warranties|this software is provided by the copyright holders and contributors as is and any express or implied warranties
isc|2|permission|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd|2|permission|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hpnd|2|permission|permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
postgresql|2|permission|permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
mpl-1.1|2|mozilla|the contents of this file are subject to the mozilla public {l} {v}1 1
mpl-1.0|2|mozilla|the contents of this file are subject to the mozilla public {l} {v}1 0
mpl-2.0|2|mozilla|this source code form is subject to the terms of the mozilla public {l} v 2 0
mpl-2.0|2|mozilla|this source code form is subject to the terms of the mozilla public {l} {v}2 0
npl-1.1|2|netscape|the contents of this file are subject to the netscape public {l}
cddl-1.0|2|common development|subject to the terms of the common development and distribution {l}
epl-1.0|2|eclipse|made available under the terms of the eclipse public {l} v1 0
epl-2.0|2|eclipse|made available under the terms of the eclipse public {l} (?:v 2 0|2 0|v2 0)
edl-1.0|2|eclipse|eclipse distribution {l} v ?1 0
zlib|2|misrepresented|the origin of this software must not be misrepresented
zlib|2|altered|altered source versions must be plainly marked as such
libpng|2|png reference|png reference library {l}
bsl-1.0|2|boost|distributed under the boost software {l} {v}1 0
bsl-1.0|2|machine executable|machine executable object code generated by a source language processor
unlicense|2|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|2|fuck|do what the fuck you want to(?: public {l})?
cc0-1.0|2|waived|(?:has|have) waived all copyright and related or neighboring rights
cc0-1.0|2|dedicated|dedicated (?:the|this) work to the public domain
artistic-1.0|2|artistic|maintains some semblance of artistic control over the development of the package
artistic-2.0|2|artistic|everyone is permitted to copy and distribute verbatim copies of this {l} document but changing it is not allowed artistic
ofl-1.1|2|font software|this font software is licensed under the sil open font {l} {v}1 1
ofl-1.0|2|font software|this font software is licensed under the sil open font {l} {v}1 0
openssl|2|openssl|this product includes software developed by the openssl project
ssleay|2|eric young|this product includes cryptographic software written by eric young
php-3.01|2|php|this product includes php software freely available
python-2.0|2|python|psf is making python available to licensee on an as is basis
ms-pl|2|microsoft|microsoft public {l} this {l} governs use of the accompanying software
ms-rl|2|microsoft|microsoft reciprocal {l} this {l} governs use of the accompanying software
json|2|evil|the software shall be used for good not evil
beerware|2|beer|you can buy me a beer in return
ijg|2|jpeg|this software is based in part on the work of the independent jpeg group
unicode|2|unicode|permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c|2|w3c|w3c software (?:and document )?notice and {l}
sspl-1.0|2|service source|offering the program as a service source code
busl-1.1|2|effective|effective on the change date
elastic-2.0|2|managed service|you may not provide the software to third parties as a hosted or managed service
commons-clause|2|commons clause|commons clause {l} condition
odbl-1.0|2|open database|made available under the open database {l}
gfdl|2|free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {l}
lppl|2|latex|distributed and or modified under the conditions of the latex project public {l}
sleepycat|2|accompanying software|redistributions in any form must be accompanied by information on how to obtain complete source code
vim|2|vim|you are allowed to distribute an unmodified copy of vim
zpl|2|zope|this software is copyright zope corporation
gpl-1.0|3|gpl|gnu gpl {v}1(?: 0)?
gpl-2.0-or-later|3|gpl|(?:gnu )?gpl {v}2(?: 0)?(?: \+)? or (?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later|3|gpl|(?:gnu )?gpl {v}3(?: 0)? or (?:any )?(?:later|newer)(?: version)?
gpl-2.0|3|gpl|(?:gnu )?gpl {v}2(?: 0)?
gpl-2.0|3|gplv2|(?:gnu )?gplv2(?: 0)?
gpl-3.0|3|gpl|(?:gnu )?gpl {v}3(?: 0)?
gpl-3.0|3|gplv3|(?:gnu )?gplv3(?: 0)?
gpl-1.0|3|general public|gnu general public {l} {v}1(?: 0)?
gpl-2.0|3|general public|(?:gnu )?general public {l} {v}2(?: 0)?
gpl-3.0|3|general public|(?:gnu )?general public {l} {v}3(?: 0)?
lgpl-2.0|3|lgpl|(?:gnu )?lgpl {v}2(?: 0)?
lgpl-2.1|3|lgpl|(?:gnu )?lgpl {v}2 1
lgpl-2.1|3|lgplv2|(?:gnu )?lgplv2 1
lgpl-3.0|3|lgpl|(?:gnu )?lgpl {v}3(?: 0)?
lgpl-3.0|3|lgplv3|(?:gnu )?lgplv3(?: 0)?
lgpl-2.1|3|lesser general|(?:gnu )?lesser general public {l} {v}2 1
lgpl-3.0|3|lesser general|(?:gnu )?lesser general public {l} {v}3(?: 0)?
lgpl-2.0|3|library general|(?:gnu )?library general public {l} {v}2(?: 0)?
agpl-1.0|3|affero|affero general public {l} {v}1(?: 0)?
agpl-3.0|3|affero|(?:gnu )?affero general public {l} {v}3(?: 0)?
agpl-3.0|3|agpl|(?:gnu )?agpl {v}3(?: 0)?
agpl-3.0|3|agplv3|(?:gnu )?agplv3(?: 0)?
gfdl-1.1|3|documentation|(?:gnu )?free documentation {l} {v}1 1
gfdl-1.2|3|documentation|(?:gnu )?free documentation {l} {v}1 2
gfdl-1.3|3|documentation|(?:gnu )?free documentation {l} {v}1 3
apache-1.0|3|apache|apache(?: software)?(?: {l})? {v}1 0
apache-1.1|3|apache|apache(?: software)?(?: {l})? {v}1 1
apache-2.0|3|apache|apache(?: software)?(?: {l})? {v}2(?: 0)?
apache-2.0|3|apache2|apache2(?: 0)?(?: {l})?
mpl-1.0|3|mozilla|mozilla public {l} {v}1 0
mpl-1.1|3|mozilla|mozilla public {l} {v}1 1
mpl-2.0|3|mozilla|mozilla public {l} {v}2(?: 0)?
mpl-1.1|3|mpl|mpl {v}1 1
mpl-2.0|3|mpl|mpl {v}2(?: 0)?
epl-1.0|3|eclipse|eclipse public {l} {v}1(?: 0)?
epl-2.0|3|eclipse|eclipse public {l} {v}2(?: 0)?
epl-1.0|3|epl|epl {v}1 0
epl-2.0|3|epl|epl {v}2 0
eupl-1.0|3|european union|european union public {l} {v}1 0
eupl-1.1|3|european union|european union public {l} {v}1 1
eupl-1.2|3|european union|european union public {l} {v}1 2
eupl-1.1|3|eupl|eupl {v}1 1
eupl-1.2|3|eupl|eupl {v}1 2
cddl-1.0|3|cddl|cddl {v}1 0
cddl-1.1|3|cddl|cddl {v}1 1
cddl-1.0|3|common development|common development and distribution {l} {v}1 0
bsd-1-clause|3|bsd|(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: {l})?
bsd-2-clause|3|bsd|(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd {l}|bsd simplified)(?: {l})?
bsd-3-clause|3|bsd|(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {l})?
bsd-4-clause|3|bsd|(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {l})?
cc-by-1.0|3|cc|cc by {v}1 0
cc-by-2.0|3|cc|cc by {v}2(?: 0)?
cc-by-2.5|3|cc|cc by {v}2 5
cc-by-3.0|3|cc|cc by {v}3(?: 0)?
cc-by-4.0|3|cc|cc by {v}4(?: 0)?
cc-by-sa-2.0|3|cc|cc by sa {v}2(?: 0)?
cc-by-sa-2.5|3|cc|cc by sa {v}2 5
cc-by-sa-3.0|3|cc|cc by sa {v}3(?: 0)?
cc-by-sa-4.0|3|cc|cc by sa {v}4(?: 0)?
cc-by-nc-2.0|3|cc|cc by nc {v}2(?: 0)?
cc-by-nc-2.5|3|cc|cc by nc {v}2 5
cc-by-nc-3.0|3|cc|cc by nc {v}3(?: 0)?
cc-by-nc-4.0|3|cc|cc by nc {v}4(?: 0)?
cc-by-nd-3.0|3|cc|cc by nd {v}3(?: 0)?
cc-by-nd-4.0|3|cc|cc by nd {v}4(?: 0)?
cc-by-nc-sa-2.0|3|cc|cc by nc sa {v}2(?: 0)?
cc-by-nc-sa-3.0|3|cc|cc by nc sa {v}3(?: 0)?
cc-by-nc-sa-4.0|3|cc|cc by nc sa {v}4(?: 0)?
cc-by-nc-nd-3.0|3|cc|cc by nc nd {v}3(?: 0)?
cc-by-nc-nd-4.0|3|cc|cc by nc nd {v}4(?: 0)?
cc-by-3.0|3|attribution|(?:creative commons )?attribution {v}3(?: 0)?(?: unported| international)?
cc-by-4.0|3|attribution|(?:creative commons )?attribution {v}4(?: 0)?(?: international)?
cc-by-sa-3.0|3|attribution|(?:creative commons )?attribution share ?alike {v}3(?: 0)?(?: unported)?
cc-by-sa-4.0|3|attribution|(?:creative commons )?attribution share ?alike {v}4(?: 0)?(?: international)?
cc-by-nc-3.0|3|attribution|(?:creative commons )?attribution non ?commercial {v}3(?: 0)?(?: unported)?
cc-by-nc-4.0|3|attribution|(?:creative commons )?attribution non ?commercial {v}4(?: 0)?(?: international)?
cc-by-nc-sa-4.0|3|attribution|(?:creative commons )?attribution non ?commercial share ?alike {v}4(?: 0)?(?: international)?
cc-by-nc-nd-4.0|3|attribution|(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s {v}4(?: 0)?(?: international)?
cc-by-nd-4.0|3|attribution|(?:creative commons )?attribution no ?deriv(?:ative)?s {v}4(?: 0)?(?: international)?
cc0-1.0|3|cc0|cc0 {v}1 0(?: universal)?
artistic-1.0|3|artistic|artistic {l} {v}1(?: 0)?
artistic-2.0|3|artistic|artistic {l} {v}2(?: 0)?
afl-2.1|3|academic|academic free {l} {v}2 1
afl-3.0|3|academic|academic free {l} {v}3(?: 0)?
osl-2.1|3|open software|open software {l} {v}2 1
osl-3.0|3|open software|open software {l} {v}3(?: 0)?
ofl-1.0|3|open font|(?:sil )?open font {l} {v}1 0
ofl-1.1|3|open font|(?:sil )?open font {l} {v}1 1
bsl-1.0|3|boost|boost software {l} {v}1 0
busl-1.1|3|business source|business source {l} {v}1 1
sspl-1.0|3|server side|server side public {l} {v}1(?: 0)?
cpl-1.0|3|common public|common public {l} {v}1 0
cpal-1.0|3|common public|common public attribution {l} {v}1 0
ipl-1.0|3|ibm|ibm public {l} {v}1 0
apsl-2.0|3|apple|apple public source {l} {v}2(?: 0)?
php-3.0|3|php|php {l} {v}3 0
php-3.01|3|php|php {l} {v}3 01
python-2.0|3|python|python(?: software foundation)? {l} {v}2
zpl-2.0|3|zope|zope public {l} {v}2 0
zpl-2.1|3|zope|zope public {l} {v}2 1
w3c-2015|3|w3c|w3c software and document {l} 2015
lppl-1.2|3|latex|latex project public {l} {v}1 2
lppl-1.3c|3|latex|latex project public {l} {v}1 3c?
cecill-2.0|3|cecill|cecill {v}2(?: 0)?
cecill-2.1|3|cecill|cecill {v}2 1
mulan-psl-2.0|3|mulan|mulan (?:psl|permissive software {l}) {v}2
upl-1.0|3|universal permissive|universal permissive {l} {v}1 0
ecl-2.0|3|educational|educational community {l} {v}2 0
odbl-1.0|3|open database|open (?:data commons )?open database {l} {v}1 0
sissl-1.1|3|industry standards|sun industry standards source {l} {v}1 1
nasa-1.3|3|nasa|nasa open source agreement {v}1 3
rpl-1.5|3|reciprocal|reciprocal public {l} {v}1 5
qpl-1.0|3|public|(?:q|qt) public {l} {v}1 0
gpl|4|gpl|(?:gnu )?gpl
gpl|4|general public|(?:gnu )?general public {l}
lgpl|4|lgpl|(?:gnu )?lgpl
lgpl|4|general public|(?:gnu )?(?:lesser|library) general public {l}
agpl|4|agpl|(?:gnu )?agpl
agpl|4|affero|(?:gnu )?affero general public {l}
gfdl|4|documentation|gnu free documentation {l}
apache|4|apache|apache(?: software)? {l}
mit|4|mit|(?:the )?mit(?: x11)? {l}
mit|4|expat|expat {l}
x11|4|x11|x11 {l}
bsd|4|bsd|bsd(?: style)? {l}
isc|4|isc|isc {l}
mpl|4|mozilla|mozilla public {l}
epl|4|eclipse|eclipse public {l}
eupl|4|european union|european union public {l}
cddl|4|common development|common development and distribution {l}
zlib|4|zlib|zlib(?: libpng)? {l}
cc-by-sa|4|cc|cc by sa
cc-by-nc|4|cc|cc by nc
cc-by-nd|4|cc|cc by nd
cc-by-nc-sa|4|cc|cc by nc sa
cc-by-nc-nd|4|cc|cc by nc nd
cc-by|4|cc|cc by
cc0|4|cc0|cc0
creative-commons|4|creative commons|creative commons(?: [^ ]+)? {l}
ofl|4|open font|(?:sil )?open font {l}
artistic|4|artistic|(?:perl )?artistic {l}
bsl|4|boost|boost (?:software )?{l}
busl|4|business source|business source {l}
sspl|4|server side|server side public {l}
elastic|4|elastic|elastic {l}
polyform|4|polyform|polyform (?:noncommercial|small business|shield|strict|perimeter) {l}
unlicense|4|unlicense|(?:the )?unlicense
wtfpl|4|wtfpl|wtfpl
beerware|4|beerware|beerware {l}
ms-pl|4|microsoft|microsoft public {l}
ms-rl|4|microsoft|microsoft reciprocal {l}
python|4|python|python software foundation {l}
ruby|4|ruby|ruby {l}
php|4|php|php {l}
openssl|4|openssl|openssl {l}
postgresql|4|postgresql|postgresql {l}
ncsa|4|illinois|university of illinois (?:ncsa )?open source {l}
odbl|4|open database|open database {l}
pddl|4|public domain dedication|public domain dedication and {l}
cecill|4|cecill|cecill(?: b| c)?(?: {l})?
lppl|4|latex|latex project public {l}
public-domain|5|public domain|(?:in|into|to) the public domain
dual|5|dual|dual licensed
proprietary|5|rights reserved|all rights reserved
proprietary|5|proprietary|proprietary and confidential
copyright|5|copyright|copyright (?:c )?(?:19|20)[0-9][0-9]
no-warranty|5|kind|without warrant(?:y|ies) of any kind
see-license|5|details|see (?:the )?{l}(?: file)? for (?:more )?details
unnamed-open|5|open source|(?:an |the )?open source {l}
"""

#: The base phrases, searched on their own; what they find always stays.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)


def spaced(pattern: str) -> str:
    """The pattern over text in which each gap between words is two blanks and each end is one, so that neighbouring matches share none."""
    return f" ({pattern.replace(' ?', '(?: )?').replace(' ', '  ')}) "


def rules() -> list[tuple[int, int, str, list[str], str]]:
    """(order, tier, label, words of the keyword, pattern)."""
    found = []
    for k, line in enumerate(TEXT.strip().splitlines()):
        label, tier, keyword, pattern = line.split("|", 3)
        found.append((k, int(tier), label, keyword.split(), spaced(pattern.replace("{v}", "(?:version |ver |v )?v?").replace("{l}", "licen[cs]e"))))
    return found
