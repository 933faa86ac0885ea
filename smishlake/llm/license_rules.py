"""Signature rules for license scans, written by hand: one per line, in order of priority.

A line holds a label, the weight of the evidence, and a regex over normalised text (lower case, single spaces between
words). Groups do not nest and only groups and classes are optional or alternative, so the longest literal stretch of a
regex is a keyword that must occur before it is tried. Facts about public licences (fixed values).
"""

from __future__ import annotations

#: Identifiers as machines write them.
IDENTIFIERS = r"""
mit 1.0 spdx license identifier (?:mit|expat)
mit-0 1.0 spdx license identifier mit 0
x11 1.0 spdx license identifier x11
0bsd 1.0 spdx license identifier 0bsd
bsd-2-clause 1.0 spdx license identifier bsd 2 clause(?: views| patent)?
bsd-3-clause 1.0 spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause 1.0 spdx license identifier bsd 4 clause(?: uc)?
bsd-1-clause 1.0 spdx license identifier bsd 1 clause
apache-1.0 1.0 spdx license identifier apache 1 0
apache-1.1 1.0 spdx license identifier apache 1 1
apache-2.0 1.0 spdx license identifier apache 2 0
gpl-1.0 1.0 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 1.0 spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 1.0 spdx license identifier gpl 3 0(?: only| or later)?
lgpl 1.0 spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl 1.0 spdx license identifier lgpl 3 0(?: only| or later)?
agpl-1.0 1.0 spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0 1.0 spdx license identifier agpl 3 0(?: only| or later)?
mpl-1.0 1.0 spdx license identifier mpl 1 0
mpl-1.1 1.0 spdx license identifier mpl 1 1
mpl-2.0 1.0 spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 1.0 spdx license identifier epl 1 0
epl-2.0 1.0 spdx license identifier epl 2 0
cddl 1.0 spdx license identifier cddl 1 [01]
isc 1.0 spdx license identifier isc
zlib 1.0 spdx license identifier (?:zlib|libpng|libpng 2 0)
unlicense 1.0 spdx license identifier unlicense
cc0-1.0 1.0 spdx license identifier cc0 1 0
cc-by-2.0 1.0 spdx license identifier cc by 2 [05]
cc-by-3.0 1.0 spdx license identifier cc by 3 0
cc-by-4.0 1.0 spdx license identifier cc by 4 0
cc-by-sa-2.0 1.0 spdx license identifier cc by sa 2 [05]
cc-by-sa-3.0 1.0 spdx license identifier cc by sa 3 0
cc-by-sa-4.0 1.0 spdx license identifier cc by sa 4 0
cc-by-nd-4.0 1.0 spdx license identifier cc by nd 4 0
cc-by-nc-3.0 1.0 spdx license identifier cc by nc 3 0
cc-by-nc-4.0 1.0 spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 1.0 spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 1.0 spdx license identifier cc by nc nd 4 0
artistic-1.0 1.0 spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 1.0 spdx license identifier artistic 2 0
bsl-1.0 1.0 spdx license identifier bsl 1 0
wtfpl 1.0 spdx license identifier wtfpl
ofl-1.1 1.0 spdx license identifier ofl 1 [01](?: rfn| no rfn)?
postgresql 1.0 spdx license identifier postgresql
python-2.0 1.0 spdx license identifier (?:python|psf) 2 0
openssl 1.0 spdx license identifier openssl
php-3.01 1.0 spdx license identifier php 3 01
ruby 1.0 spdx license identifier ruby
vim 1.0 spdx license identifier vim
eupl-1.1 1.0 spdx license identifier eupl 1 [01]
eupl-1.2 1.0 spdx license identifier eupl 1 2
ms-pl 1.0 spdx license identifier ms pl
ms-rl 1.0 spdx license identifier ms rl
odbl-1.0 1.0 spdx license identifier odbl 1 0
odc-by-1.0 1.0 spdx license identifier odc by 1 0
pddl-1.0 1.0 spdx license identifier pddl 1 0
busl-1.1 1.0 spdx license identifier busl 1 1
sspl-1.0 1.0 spdx license identifier sspl 1 0
elastic-2.0 1.0 spdx license identifier elastic 2 0
gfdl 1.0 spdx license identifier gfdl 1 [123](?: only| or later)?
afl-3.0 1.0 spdx license identifier afl [123] [01]
osl-3.0 1.0 spdx license identifier osl [123] [01]
cecill 1.0 spdx license identifier cecill (?:1 0|2 0|2 1|b|c)
ncsa 1.0 spdx license identifier ncsa
upl-1.0 1.0 spdx license identifier upl 1 0
blueoak-1.0.0 1.0 spdx license identifier blueoak 1 0 0
hpnd 1.0 spdx license identifier hpnd
w3c 1.0 spdx license identifier w3c(?: 20150513| 19980720)?
curl 1.0 spdx license identifier curl
zpl-2.1 1.0 spdx license identifier zpl 2 [01]
ipl-1.0 1.0 spdx license identifier ipl 1 0
cpl-1.0 1.0 spdx license identifier cpl 1 0
apsl-2.0 1.0 spdx license identifier apsl [12] [012]
sleepycat 1.0 spdx license identifier sleepycat
tcl 1.0 spdx license identifier tcl
mulan-2.0 1.0 spdx license identifier mulanpsl 2 0
polyform 1.0 spdx license identifier polyform (?:noncommercial|small business|strict|shield) 1 0 0
"""

#: Sentences of notices and grants that name one licence or stand in the text of one alone.
GRANTS = r"""
mit 0.95 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.9 to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit 0.95 (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[cs]e
mit 0.9 (?:is|are) mit licensed
mit 0.85 (?:see|governed by|subject to|covered by) (?:the )?mit licen[cs]e
x11 0.9 except as contained in this notice the name of the x consortium shall not be used
apache-2.0 0.95 licensed under the apache license version 2 0 the license
apache-2.0 0.95 (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache (?:license |licence )?(?:version |v)?2 0
apache-2.0 0.95 www apache org licenses license 2 0
apache-2.0 0.8 you may not use this file except in compliance with the license
apache-1.1 0.9 this product includes software developed by the apache software foundation
apache-2.0 0.85 licensed to the apache software foundation asf under one or more contributor license agreements
gpl-3.0 0.95 terms of the gnu general public license as published by the free software foundation either version 3
gpl-2.0 0.95 terms of the gnu general public license as published by the free software foundation either version 2
gpl-3.0 0.95 terms of the gnu general public license version 3
gpl-2.0 0.95 terms of the gnu general public license version 2
gpl-3.0 0.95 (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl (?:version |v)?3
gpl-2.0 0.95 (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl (?:version |v)?2
gpl-3.0 0.9 (?:licensed|released|distributed|available) under (?:the )?gplv3
gpl-2.0 0.9 (?:licensed|released|distributed|available) under (?:the )?gplv2
gpl 0.9 (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?general public license
gpl 0.85 you should have received a copy of the gnu general public license along with this
gpl 0.8 it under the terms of the gnu general public license
lgpl 0.95 terms of the gnu (?:lesser|library) general public license
lgpl 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl
lgpl 0.85 you should have received a copy of the gnu (?:lesser|library) general public license
agpl-3.0 0.95 terms of the gnu affero general public license
agpl-3.0 0.9 (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agpl
agpl-3.0 0.85 you should have received a copy of the gnu affero general public license
bsd 0.9 redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause 0.95 neither the name of (?:the|its) [a-z ]{0,80}contributors may be used to endorse or promote products
bsd-3-clause 0.9 may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause 0.95 all advertising materials mentioning features or use of this software must display the following acknowledg
bsd 0.8 redistributions in binary form must reproduce the above copyright notice
bsd 0.95 (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?bsd licen[cs]e
bsd-3-clause 0.95 (?:licensed|released|distributed|available) under (?:the |a )?(?:3 clause|three clause|new|modified|revised) bsd
bsd-2-clause 0.95 (?:licensed|released|distributed|available) under (?:the |a )?(?:2 clause|two clause|simplified|freebsd) bsd
mpl-2.0 0.95 subject to the terms of the mozilla public license v 2 0
mpl-1.1 0.95 subject to the mozilla public license version 1 1
mpl-2.0 0.9 (?:licensed|released|distributed|available) under (?:the )?mpl (?:version |v)?2 0
epl-2.0 0.95 made available under the terms of the eclipse public license (?:version |v )?2 0
epl-1.0 0.95 made available under the terms of the eclipse public license (?:version |v )?1 0
cddl 0.95 subject to the terms of the common development and distribution license
isc 0.95 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 0.9 permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
zlib 0.95 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 0.9 altered source versions must be plainly marked as such
unlicense 0.95 this is free and unencumbered software released into the public domain
unlicense 0.9 for more information please refer to (?:http|https) unlicense org
cc0-1.0 0.95 to the extent possible under law [a-z0-9 ]{0,80}has waived all copyright
cc0-1.0 0.95 creativecommons org publicdomain zero 1 0
cc-by-4.0 0.95 creativecommons org licenses by 4 0
cc-by-3.0 0.95 creativecommons org licenses by 3 0
cc-by-sa-4.0 0.95 creativecommons org licenses by sa 4 0
cc-by-sa-3.0 0.95 creativecommons org licenses by sa 3 0
cc-by-nc-4.0 0.95 creativecommons org licenses by nc 4 0
cc-by-nd-4.0 0.95 creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 0.95 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 0.95 creativecommons org licenses by nc nd 4 0
artistic-2.0 0.9 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms
artistic-1.0 0.9 same terms as perl itself
bsl-1.0 0.95 distributed under the boost software license version 1 0
wtfpl 0.95 do what the fuck you want to public license
ofl-1.1 0.95 this font software is licensed under the sil open font license
postgresql 0.9 without fee and without a written agreement is hereby granted
python-2.0 0.9 psf hereby grants licensee a nonexclusive royalty free world wide license
openssl 0.9 this product includes software developed by the openssl project
php-3.01 0.9 this product includes php software freely available from
eupl-1.2 0.95 licensed under the eupl version 1 2
eupl-1.1 0.95 licensed under the eupl version 1 1
ms-pl 0.9 this license governs use of the accompanying software if you use the software you accept this license
odbl-1.0 0.95 made available under the open database license
odc-by-1.0 0.95 made available under the open data commons attribution license
pddl-1.0 0.95 made available under the public domain dedication and license
busl-1.1 0.9 change date [a-z0-9 ]{0,80}change license
elastic-2.0 0.9 you may not provide the software to third parties as a hosted or managed service
sspl-1.0 0.9 making the functionality of the program or modified version available to third parties as a service
gfdl 0.95 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
ncsa 0.9 to deal with the software without restriction
w3c 0.9 this work is being provided by the copyright holders under the following license
beerware 0.95 if we meet some day and you think this stuff is worth it you can buy me a beer
json 0.95 the software shall be used for good not evil
commons-clause 0.95 the license does not grant to you the right to sell the software
llama 0.9 (?:llama|llama 2|llama 3) community license agreement
openrail 0.9 (?:creativeml|bigscience|bigcode) openrail
openrail 0.9 (?:creativeml|bigscience|bigcode) open rail
"""

#: Names with their version or kind.
NAMES = r"""
mit-0 0.8 mit no attribution(?: license)?
mit 0.75 expat licen[cs]e
x11 0.75 x11 licen[cs]e
apache-2.0 0.8 apache licen[cs]e version 2 0
apache-2.0 0.8 apache licen[cs]e (?:v)?2 0
apache-2.0 0.8 apache 2 0 licen[cs]e
apache-2.0 0.8 apache software license (?:version )?2 0
apache-1.1 0.8 apache software license (?:version )?1 1
apache-1.1 0.8 apache license (?:version )?1 1
gpl-3.0 0.8 gnu general public license (?:version |v)?3(?: 0)?
gpl-2.0 0.8 gnu general public license (?:version |v)?2(?: 0)?
gpl-1.0 0.8 gnu general public license (?:version |v)?1(?: 0)?
gpl-3.0 0.75 gnu gpl (?:version |v)?3(?: 0)?
gpl-2.0 0.75 gnu gpl (?:version |v)?2(?: 0)?
gpl-3.0 0.75 gnu gpl v3
gpl-2.0 0.75 gnu gpl v2
gpl-3.0 0.75 (?:gnu )?gplv3
gpl-2.0 0.75 (?:gnu )?gplv2
gpl-3.0 0.7 gpl 3 0(?: only| or later)?
gpl-2.0 0.7 gpl 2 0(?: only| or later)?
lgpl 0.8 gnu lesser general public license
lgpl 0.8 gnu library general public license
lgpl 0.75 lgplv[23]
lgpl 0.75 lgplv2 1
lgpl 0.75 lgpl 2 1(?: only| or later)?
lgpl 0.75 lgpl 3 0(?: only| or later)?
agpl-3.0 0.8 gnu affero general public license
agpl-3.0 0.75 affero gpl
agpl-3.0 0.75 agplv3
agpl-3.0 0.75 agpl 3 0(?: only| or later)?
bsd-3-clause 0.8 (?:3 clause|three clause) bsd(?: licence| license)?
bsd-3-clause 0.8 bsd 3 clause(?: licence| license)?
bsd-3-clause 0.75 new bsd licen[cs]e
bsd-3-clause 0.75 (?:modified|revised) bsd licen[cs]e
bsd-2-clause 0.8 (?:2 clause|two clause) bsd(?: licence| license)?
bsd-2-clause 0.8 bsd 2 clause(?: licence| license)?
bsd-2-clause 0.75 simplified bsd licen[cs]e
bsd-2-clause 0.75 freebsd licen[cs]e
bsd-4-clause 0.8 (?:4 clause|four clause|original) bsd licen[cs]e
0bsd 0.8 (?:zero clause|0 clause) bsd(?: licence| license)?
mpl-2.0 0.8 mozilla public licen[cs]e (?:version |v )?2 0
mpl-1.1 0.8 mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.0 0.8 mozilla public licen[cs]e (?:version |v )?1 0
epl-2.0 0.8 eclipse public licen[cs]e (?:version |v )?2 0
epl-1.0 0.8 eclipse public licen[cs]e (?:version |v )?1 0
cddl 0.8 common development and distribution licen[cs]e
isc 0.75 isc licen[cs]e
zlib 0.75 zlib (?:libpng )?licen[cs]e
unlicense 0.75 the unlicense
cc0-1.0 0.8 cc0 1 0(?: universal)?
cc0-1.0 0.8 creative commons zero
cc-by-4.0 0.8 creative commons attribution 4 0
cc-by-3.0 0.8 creative commons attribution 3 0
cc-by-2.0 0.8 creative commons attribution 2 [05]
cc-by-sa-4.0 0.8 creative commons attribution (?:share alike|sharealike) 4 0
cc-by-sa-3.0 0.8 creative commons attribution (?:share alike|sharealike) 3 0
cc-by-nc-4.0 0.8 creative commons attribution (?:non commercial|noncommercial) 4 0
cc-by-nc-sa-4.0 0.8 creative commons attribution (?:non commercial|noncommercial) (?:share alike|sharealike) 4 0
cc-by-nc-nd-4.0 0.8 creative commons attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives) 4 0
cc-by-nd-4.0 0.8 creative commons attribution (?:no derivatives|noderivatives) 4 0
cc-by-4.0 0.75 cc by 4 0
cc-by-3.0 0.75 cc by 3 0
cc-by-sa-4.0 0.75 cc by sa 4 0
cc-by-sa-3.0 0.75 cc by sa 3 0
cc-by-nc-4.0 0.75 cc by nc 4 0
cc-by-nc-sa-4.0 0.75 cc by nc sa 4 0
cc-by-nc-nd-4.0 0.75 cc by nc nd 4 0
cc-by-nd-4.0 0.75 cc by nd 4 0
artistic-2.0 0.8 artistic licen[cs]e (?:version )?2 0
artistic-1.0 0.75 artistic licen[cs]e (?:version )?1 0
bsl-1.0 0.8 boost software licen[cs]e
bsl-1.0 0.75 boost licen[cs]e 1 0
ofl-1.1 0.8 sil open font licen[cs]e
ofl-1.1 0.75 open font licen[cs]e(?: version 1 1)?
postgresql 0.75 postgresql licen[cs]e
python-2.0 0.75 python software foundation licen[cs]e
python-2.0 0.7 psf licen[cs]e
openssl 0.75 openssl licen[cs]e
php-3.01 0.75 php licen[cs]e (?:version )?3 01
ruby 0.7 ruby licen[cs]e
vim 0.7 vim licen[cs]e
eupl-1.2 0.8 european union public licen[cs]e (?:version |v )?1 2
eupl 0.75 european union public licen[cs]e
ms-pl 0.75 microsoft public licen[cs]e
ms-rl 0.75 microsoft reciprocal licen[cs]e
odbl-1.0 0.75 open database licen[cs]e
odc-by-1.0 0.75 open data commons attribution licen[cs]e
pddl-1.0 0.75 public domain dedication and licen[cs]e
busl-1.1 0.75 business source licen[cs]e
sspl-1.0 0.75 server side public licen[cs]e
elastic-2.0 0.75 elastic licen[cs]e (?:version )?2 0
gfdl 0.75 gnu free documentation licen[cs]e
gfdl 0.7 gfdl 1 [123](?: only| or later)?
afl-3.0 0.75 academic free licen[cs]e
osl-3.0 0.75 open software licen[cs]e (?:version )?3 0
cecill 0.75 cecill (?:b |c )?(?:free software )?licen[cs]e
ncsa 0.75 university of illinois ncsa open source licen[cs]e
upl-1.0 0.75 universal permissive licen[cs]e
blueoak-1.0.0 0.75 blue oak model licen[cs]e
zpl-2.1 0.75 zope public licen[cs]e
ipl-1.0 0.75 ibm public licen[cs]e
cpl-1.0 0.75 common public licen[cs]e
apsl-2.0 0.75 apple public source licen[cs]e
sleepycat 0.75 sleepycat licen[cs]e
mulan-2.0 0.75 mulan permissive software licen[cs]e
polyform 0.75 polyform (?:noncommercial|small business|strict|shield) licen[cs]e
nasa-1.3 0.75 nasa open source agreement
ogl-uk-3.0 0.75 open government licen[cs]e
etalab-2.0 0.75 licence ouverte
llama 0.75 llama [23] community licen[cs]e
openrail 0.75 openrail(?: m)? licen[cs]e
"""

#: Bare families.
FAMILIES = r"""
mit 0.7 mit licen[cs]e
apache 0.65 apache licen[cs]e
apache 0.6 apache licensed
gpl 0.65 gnu general public licen[cs]e
gpl 0.65 gnu gpl
gpl 0.6 gpl licen[cs]e
gpl 0.6 gpl licensed
lgpl 0.6 gnu lgpl
agpl-3.0 0.6 gnu agpl
bsd 0.65 bsd licen[cs]e
bsd 0.6 bsd licensed
bsd 0.6 bsd style licen[cs]e
mpl 0.65 mozilla public licen[cs]e
epl 0.65 eclipse public licen[cs]e
creative-commons 0.6 creative commons licen[cs]e
creative-commons 0.6 under a creative commons
wtfpl 0.7 wtfpl
artistic 0.6 artistic licen[cs]e
elastic 0.6 elastic licen[cs]e
mit 0.6 license mit
apache 0.6 license apache
apache-2.0 0.65 license apache 2 0
bsd 0.6 license bsd
bsd-3-clause 0.65 license bsd 3 clause
bsd-2-clause 0.65 license bsd 2 clause
gpl 0.6 license gpl
lgpl 0.6 license lgpl
agpl-3.0 0.6 license agpl
mpl 0.6 license mpl
isc 0.6 license isc
"""

#: Clauses and notices that tell a kind of terms, not a licence.
CLAUSES = r"""
public-domain 0.7 released into the public domain
public-domain 0.7 dedicated to the public domain
public-domain 0.65 (?:is|are) in the public domain
public-domain 0.6 placed in the public domain
public-domain 0.6 no copyright is claimed
proprietary 0.5 all rights reserved
proprietary 0.7 proprietary and confidential
proprietary 0.6 not for redistribution
proprietary 0.6 no part of this (?:publication|document|work) may be reproduced
proprietary 0.6 unauthori[sz]ed copying of this file
proprietary 0.6 may not be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary 0.6 end user licen[cs]e agreement
proprietary 0.5 trade secret
proprietary 0.55 licensed not sold
non-commercial 0.6 for (?:non commercial|noncommercial) use only
non-commercial 0.6 not be used for commercial purposes
non-commercial 0.55 personal use only
research-only 0.6 for (?:academic|research) (?:purposes|use) only
no-derivatives 0.55 no derivative works
attribution 0.5 attribution required
disclaimer 0.4 the software is provided as is without warranty of any kind
disclaimer 0.4 without warranty of any kind express or implied
disclaimer 0.4 in no event shall the (?:authors|author|copyright holders) (?:or copyright holders )?be liable for any claim
disclaimer 0.4 without even the implied warranty of merchantability or fitness for a particular purpose
disclaimer 0.4 any express or implied warranties including but not limited to the implied warranties
notice 0.4 this copyright notice and this permission notice appear in all copies
notice 0.4 the above copyright notice and this permission notice shall be included in all copies
notice 0.4 see the license for the specific language governing permissions and limitations
notice 0.35 see the license file
notice 0.35 licen[cs]e agreement
"""

TIERS = (IDENTIFIERS, GRANTS, NAMES, FAMILIES, CLAUSES)
