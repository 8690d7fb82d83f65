"""Signature rules of the licence scan.

One rule a line: label, kind, keyword, pattern. Patterns are matched against a text reduced to lower-case words joined
by single spaces, from a word's start to a word's end. The keyword is a string that every match of the pattern holds;
the rule's pattern is only tried on texts that hold it. Kinds in order of priority: ``tag`` (machine-readable
identifiers), ``text`` (sentences of the licence itself), ``notice`` (statements that something is licensed so),
``name`` (the licence's name or address alone), ``hint`` (wording that shows some licence, without saying which).
"""

from __future__ import annotations

#: kind -> (priority, confidence)
KINDS = {"tag": (1, 0.99), "text": (2, 0.97), "notice": (3, 0.95), "name": (4, 0.8), "hint": (5, 0.4)}

_RULES = r"""
mit | tag | spdx license identifier | spdx license identifier mit
mit | text | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | substantial portions of the software | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | notice | mit license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit license
mit | notice | licensed under | licensed under (?:the )?mit
mit | notice | licensed mit | (?:is|are) licensed mit
mit | name | mit license | (?:the )?(?:mit|expat) license
mit | name | expat | expat licen[cs]e
mit | name | mit | mit licen[cs]ed
mit | name | opensource org licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
mit-0 | tag | spdx license identifier | spdx license identifier mit 0
mit-0 | name | mit no attribution | mit no attribution(?: license)?
x11 | tag | spdx license identifier | spdx license identifier x11
x11 | name | x11 license | x11 license
x11 | text | x consortium | the name of the x consortium shall not be used in advertising
apache-2.0 | tag | spdx license identifier | spdx license identifier apache 2 0
apache-2.0 | text | apache license | apache license version 2 0 january 2004
apache-2.0 | text | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | text | you may not use this file except | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | text | without warranties or conditions of any kind | distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | notice | apache license | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache license(?: version)?(?: v)? ?2(?: 0)?
apache-2.0 | notice | apache 2 | (?:licensed|released|distributed|available) under (?:the )?apache 2(?: 0)?
apache-2.0 | name | apache license | apache license(?: version)?(?: v)? 2(?: 0)?
apache-2.0 | name | apache license v2 | apache license v2(?: 0)?
apache-2.0 | name | apache 2 0 | apache 2 0(?: license)?
apache-2.0 | name | asl 2 0 license | asl 2 0 license
apache-2.0 | name | licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | tag | spdx license identifier | spdx license identifier apache 1 1
apache-1.1 | name | apache software license | (?:the )?apache software license version 1 1
apache-1.1 | text | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | text | apache group | this product includes software developed by the apache group
apache-1.0 | tag | spdx license identifier | spdx license identifier apache 1 0
apache | name | apache license | (?:the )?apache license
apache | name | apache software license | (?:the )?apache software license
gpl-3.0-or-later | tag | spdx license identifier | spdx license identifier gpl 3 0 (?:or later|plus)
gpl-3.0-only | tag | spdx license identifier | spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later | tag | spdx license identifier | spdx license identifier gpl 2 0 (?:or later|plus)
gpl-2.0-only | tag | spdx license identifier | spdx license identifier gpl 2 0(?: only)?
gpl-1.0 | tag | spdx license identifier | spdx license identifier gpl 1 0(?: only| or later)?
gpl-3.0 | text | general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2.0 | text | general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-1.0 | text | general public license version 1 february 1989 | gnu general public license version 1 february 1989
gpl-3.0 | notice | general public license version 3 | licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public license version 3(?: 0)?
gpl-2.0 | notice | general public license version 2 | licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public license version 2(?: 0)?
gpl-3.0-or-later | notice | either version 3 of the license | general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0-or-later | notice | either version 2 of the license | general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0 | notice | version 3 of the | version 3 of the gnu general public license
gpl-2.0 | notice | version 2 of the | version 2 of the gnu general public license
gpl-3.0 | name | general public license | (?:gnu )?general public license (?:version |v ?)3(?: 0)?
gpl-2.0 | name | general public license | (?:gnu )?general public license (?:version |v ?)2(?: 0)?
gpl-3.0 | name | gpl | (?:gnu )?gpl ?v? ?3(?: 0)?
gpl-2.0 | name | gpl | (?:gnu )?gpl ?v? ?2(?: 0)?
gpl-3.0 | name | licenses gpl 3 0 | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-2.0 | name | licenses old licenses gpl 2 0 | (?:https? )?(?:www )?gnu org licenses old licenses gpl 2 0(?: en)?(?: html| txt)?
gpl | text | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|library|software|file)
gpl | text | without even the implied warranty of merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl | text | this program is free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | notice | general public license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public license
gpl | name | general public license | (?:gnu )?general public license
gpl | name | gnu gpl | gnu gpl
gpl | name | gpl license | gpl license
gpl | name | licenses gpl html | (?:https? )?(?:www )?gnu org licenses gpl html
lgpl-3.0 | tag | spdx license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | tag | spdx license identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 | tag | spdx license identifier | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-3.0 | text | lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
lgpl-2.1 | text | lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2.0 | text | library general public license version 2 june 1991 | gnu library general public license version 2 june 1991
lgpl-3.0 | name | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)3(?: 0)?
lgpl-2.1 | name | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)2 1
lgpl-3.0 | name | lgpl | (?:gnu )?lgpl ?v? ?3(?: 0)?
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl ?v? ?2 1
lgpl | notice | lesser general public license as published | lesser general public license as published by the free software foundation
lgpl | text | you should have received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license
lgpl | name | lesser general public license | (?:gnu )?lesser general public license
lgpl | name | library general public license | (?:gnu )?library general public license
lgpl | name | gnu lgpl | gnu lgpl
agpl-3.0 | tag | spdx license identifier | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | text | affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl-3.0 | name | affero general public license | (?:gnu )?affero general public license (?:version |v ?)3(?: 0)?
agpl-3.0 | name | agpl | (?:gnu )?agpl ?v? ?3(?: 0)?
agpl | text | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
agpl | name | affero general public license | (?:gnu )?affero general public license
agpl | name | gnu agpl | gnu agpl
gfdl | tag | spdx license identifier | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl | notice | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | name | free documentation license | (?:gnu )?free documentation license(?: version 1 [123])?
classpath-exception | tag | classpath exception | with classpath exception 2 0
classpath-exception | text | linking this library statically | linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception | name | gcc runtime library exception | gcc runtime library exception(?: version 3 1)?
llvm-exception | tag | llvm exception | with llvm exception
openssl-exception | text | openssl | permission to link the code of portions of this program with the openssl library
bsd-3-clause | tag | spdx license identifier | spdx license identifier bsd 3 clause
bsd-2-clause | tag | spdx license identifier | spdx license identifier bsd 2 clause
bsd-4-clause | tag | spdx license identifier | spdx license identifier bsd 4 clause
0bsd | tag | spdx license identifier | spdx license identifier 0bsd
bsd | text | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | text | may be used to endorse or promote products | neither the names? of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | text | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | name | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: license)?
bsd-3-clause | name | bsd 3 clause | bsd 3 clause(?: license)?
bsd-2-clause | name | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: license)?
bsd-2-clause | name | bsd 2 clause | bsd 2 clause(?: license)?
bsd-4-clause | name | bsd | (?:original|old|4 clause|four clause) bsd(?: license)?
0bsd | name | bsd | (?:zero clause|0 clause) bsd(?: license)?
bsd | notice | bsd | (?:licensed|released|distributed|available) under (?:the |a )?bsd(?: style)?(?: license)?
bsd | name | bsd license | bsd(?: style)? license
bsd | name | bsd licensed | bsd licensed
isc | tag | spdx license identifier | spdx license identifier isc
isc | text | permission to use copy modify and | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | name | isc license | isc license
isc | notice | licensed under | licensed under (?:the )?isc
mpl-2.0 | tag | spdx license identifier | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-1.1 | tag | spdx license identifier | spdx license identifier mpl 1 1
mpl-2.0 | text | this source code form is subject to the terms | this source code form is subject to the terms of the mozilla public license v ?2 0
mpl-1.1 | text | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | name | mozilla public license | mozilla public license (?:version |v ?)?2(?: 0)?
mpl-1.1 | name | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | name | mozilla org mpl 2 0 | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl | name | mozilla public license | mozilla public license
mpl | name | mpl 2 0 license | mpl 2 0 license
epl-2.0 | tag | spdx license identifier | spdx license identifier epl 2 0
epl-1.0 | tag | spdx license identifier | spdx license identifier epl 1 0
epl-2.0 | name | eclipse public license | eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0 | name | eclipse public license | eclipse public license (?:version |v ?)?1(?: 0)?
epl | notice | eclipse public license | the accompanying materials are made available under the terms of the eclipse public license
epl | name | eclipse public license | eclipse public license
epl | name | legal epl v | (?:https? )?(?:www )?eclipse org legal epl v ?[12]0?
edl-1.0 | name | eclipse distribution license | eclipse distribution license(?: v ?1 0)?
cddl-1.0 | tag | spdx license identifier | spdx license identifier cddl 1 [01]
cddl | text | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
cddl | name | common development and distribution license | common development and distribution license(?: version 1 [01])?
cpl-1.0 | name | common public license | common public license(?: version 1 0)?
ipl-1.0 | name | ibm public license | ibm public license(?: version 1 0)?
artistic-2.0 | tag | spdx license identifier | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic license 2 0 | artistic license 2 0
artistic-1.0 | tag | spdx license identifier | spdx license identifier artistic 1 0(?: perl)?
artistic | name | artistic license | (?:the )?artistic license
perl | notice | same terms as perl | (?:under )?the same terms as perl itself
zlib | tag | spdx license identifier | spdx license identifier zlib
zlib | text | in no event will the authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | text | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
zlib | name | zlib license | zlib(?: libpng)? license
libpng | name | libpng license | libpng license(?: version 2)?
libtiff | text | sam leffler | the names of sam leffler and silicon graphics may not be used
bsl-1.0 | tag | spdx license identifier | spdx license identifier bsl 1 0
bsl-1.0 | text | boost software license | boost software license version 1 0 17 august 2003
bsl-1.0 | notice | distributed under the boost | distributed under the boost software license(?: version 1 0)?
bsl-1.0 | name | boost software license | boost software license(?: version)?(?: 1 0)?
busl-1.1 | tag | spdx license identifier | spdx license identifier busl 1 1
busl-1.1 | name | business source license | business source license(?: 1 1)?
sspl-1.0 | tag | spdx license identifier | spdx license identifier sspl 1 0
sspl-1.0 | name | server side public license | server side public license(?: version 1)?
elastic-2.0 | name | elastic license | elastic license(?: 2 0| v2)?
commons-clause | name | commons clause | commons clause(?: license condition)?(?: v1 0)?
polyform | name | polyform | polyform (?:noncommercial|shield|small business|perimeter|strict|internal use) license(?: 1 0 0)?
unlicense | tag | spdx license identifier | spdx license identifier unlicense
unlicense | text | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | name | the unlicense | the unlicense
unlicense | name | unlicense org | (?:https? )?(?:www )?unlicense org
wtfpl | tag | spdx license identifier | spdx license identifier wtfpl
wtfpl | text | do what the | do what the f\S+ you want to public license
wtfpl | name | wtfpl | wtfpl(?: license)?
cc0-1.0 | tag | spdx license identifier | spdx license identifier cc0 1 0
cc0-1.0 | name | cc0 | cc0(?: 1 0)?(?: universal)?(?: license)?
cc0-1.0 | name | publicdomain zero | (?:https? )?creativecommons org publicdomain zero 1 0
cc0-1.0 | text | to the extent possible under law | to the extent possible under law .{1,120} has waived all copyright
cc-by-4.0 | tag | spdx license identifier | spdx license identifier cc by 4 0
cc-by-sa-4.0 | tag | spdx license identifier | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | tag | spdx license identifier | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | tag | spdx license identifier | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | tag | spdx license identifier | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | tag | spdx license identifier | spdx license identifier cc by nc nd 4 0
cc-by-nc-nd | notice | cc by nc nd | licensed under (?:a |the )?cc by nc nd(?: [1-4] [05])?(?: license)?
cc-by-nc-sa | notice | cc by nc sa | licensed under (?:a |the )?cc by nc sa(?: [1-4] [05])?(?: license)?
cc-by-nc | notice | cc by nc | licensed under (?:a |the )?cc by nc(?: [1-4] [05])?(?: license)?
cc-by-nd | notice | cc by nd | licensed under (?:a |the )?cc by nd(?: [1-4] [05])?(?: license)?
cc-by-sa | notice | cc by sa | licensed under (?:a |the )?cc by sa(?: [1-4] [05])?(?: license)?
cc-by | notice | cc by | licensed under (?:a |the )?cc by(?: [1-4] [05])?(?: license)?
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc | name | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nd | name | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-sa | name | cc by sa | cc by sa(?: [1-4] [05])?
cc-by | name | cc by | cc by [1-4] [05]
cc-by-nc-nd | name | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa | name | creative commons attribution noncommercial share | creative commons attribution noncommercial share ?alike(?: [1-4] [05])?
cc-by-nc | name | creative commons attribution non | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-sa | name | creative commons attribution share | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd | name | creative commons attribution no | creative commons attribution no ?derivatives(?: works)?(?: [1-4] [05])?
cc-by | name | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc-nd | name | licenses by nc nd | (?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | name | licenses by nc sa | (?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | name | licenses by nc | (?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]
cc-by-sa | name | licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]
cc-by-nd | name | licenses by nd | (?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]
cc-by | name | licenses by | (?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]
creative-commons | hint | creative commons | (?:a )?creative commons license
ofl-1.1 | tag | spdx license identifier | spdx license identifier ofl 1 1
ofl-1.1 | name | open font license | (?:sil )?open font license(?: version)?(?: 1 1)?
odbl-1.0 | name | open database license | open (?:data commons )?(?:open )?database license(?: odbl)?(?: v1 0)?
odc-by-1.0 | name | open data commons attribution license | open data commons attribution license
pddl-1.0 | name | public domain dedication and license | public domain dedication and license
ogl | name | open government licen | open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?
etalab | name | licence ouverte | licence ouverte(?: open licence)?
eupl-1.2 | tag | spdx license identifier | spdx license identifier eupl 1 [12]
eupl | name | european union public licen | european union public licen[cs]e(?: v(?:ersion)? ?1 [012])?
cecill | name | cecill | (?:licence )?cecill(?: b| c| 2 1)?
python-2.0 | name | python software foundation license | python software foundation license(?: version 2)?
python-2.0 | name | psf license | psf license
php-3.01 | name | php license | php license(?: version 3 01)?
ruby | name | ruby license | ruby license
openssl | name | openssl license | openssl license
openssl | text | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | text | this product includes cryptographic software | this product includes cryptographic software written by eric young
openldap | name | openldap public license | openldap public license
curl | name | curl license | curl license
postgresql | name | postgresql licen | postgresql licen[cs]e
ncsa | name | university of illinois | university of illinois(?: ncsa)? open source license
w3c | name | w3c | w3c software (?:notice and )?(?:and document )?license
unicode | name | unicode license | unicode license(?: agreement)?(?: v3)?
icu | name | icu license | icu license
afl-3.0 | name | academic free license | academic free license(?: version 3 0| v ?3 0)?
osl-3.0 | name | open software license | open software license(?: version 3 0| v ?3 0)?
ms-pl | name | microsoft public license | microsoft public license
ms-rl | name | microsoft reciprocal license | microsoft reciprocal license
ms-eula | name | microsoft software license terms | microsoft software license terms
qpl | name | q public license | q public license(?: version 1 0)?
sleepycat | name | sleepycat license | sleepycat license
vim | name | vim license | vim license
jquery | name | jquery org license | (?:https? )?jquery org license
beerware | text | beer ware license | the beer ware license(?: revision 42)?
json | text | the software shall be used for good | the software shall be used for good not evil
ijg | text | independent jpeg group | this software is based in part on the work of the independent jpeg group
tcl | text | the authors hereby grant permission | the authors hereby grant permission to use copy modify distribute and license this software
freetype | name | freetype project license | freetype project license
imagemagick | name | imagemagick license | imagemagick license
upl-1.0 | name | universal permissive license | universal permissive license(?: version)?(?: v ?)?(?: 1 0)?
ecl-2.0 | name | educational community license | educational community license(?: version 2 0)?
nosl | name | netscape public license | netscape public license(?: version 1 [01])?
apsl-2.0 | name | apple public source license | apple public source license(?: version 2 0)?
sissl | name | sun industry standards source license | sun industry standards source license
oracle-bcl | name | oracle binary code license | oracle binary code license(?: agreement)?
blueoak-1.0.0 | name | blue oak model license | blue oak model license(?: 1 0 0)?
hippocratic | name | hippocratic license | hippocratic license(?: version)?(?: 2 1| 3 0)?
mulan-psl-2.0 | name | mulan permissive software license | mulan permissive software license(?: version)?(?: v2| 2)?
openrail | name | rail | (?:creativeml |bigscience )?(?:open ?rail|openrail)(?: m| s)?(?: license)?
llama | name | llama | llama (?:2|3) community license(?: agreement)?
public-domain | notice | public domain | (?:released|dedicated|placed) (?:in|to|into) the public domain
public-domain | notice | public domain | (?:is|are) in the public domain
public-domain | hint | public domain | public domain
proprietary | notice | all rights reserved | proprietary and confidential all rights reserved
proprietary | text | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | notice | trade secret | contains (?:proprietary|confidential)(?: and confidential)? information and trade secrets?
rights-reserved | hint | all rights reserved | all rights reserved
copyright | hint | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | hint | copyright | copyright holders?
see-license | hint | license | see (?:the )?license(?: file| txt| md)?(?: for (?:more )?details)?
see-license | hint | license | license(?:d)? (?:terms|agreement|file)
dual | notice | dual licen | dual licen[cs]ed under
dual | notice | at your option | licensed under either of .{1,60} at your option
free | hint | free software | free software
warranty | hint | as is | (?:the software is )?provided as is without warranty of any kind
warranty | hint | merchantability | implied warrant(?:y|ies) of merchantability
"""


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern) in the order written."""
    out = []
    for line in _RULES.strip().splitlines():
        label, kind, keyword, pattern = line.split(" | ", 3)
        out.append((label, *KINDS[kind], keyword, pattern))
    return out
