"""The signature rules of license scans, one a line, in order: label, priority, weight, keyword (several with +), pattern.

A pattern is a regular expression over words with single spaces; case doesn't count. A text without all of a rule's keywords is not searched for it.
Priority 4: tags that tools write. 3: sentences of the licenses and their notices. 2: statements that name the license of a work. 1: mere names.
"""

#: One of these is in every text that any rule matches.
GATES = (
    "licen", " under ", "hereby granted", "permission", "redistribut", "warranty of any kind", "x consortium", "endorse or promote", "advertising materials", "free software", "merchantability", "everyone is permitted",
    "invariant sections", "this product includes", "mpl was not", "unencumbered", "anyone is free", "held liable", "must not be misrepresented", "plainly marked", "what the fuck", "the copyright holder", "public domain",
    "publicdomain", "rights reserved", "confidential", "strictly prohibited", "trade secrets", "by obtaining using", "no restrictions on", "third parties", "beer in return", "good not evil", "jpeg group", "freetype",
    "many contributors", "reserved font name", "waived all copyright", "intent of this document", "is making python", "postgresql", "remote network", "source code must retain", "complete source code", "eclipse org", "mozilla org", "gnu org", "gpl", "wtfpl", "cc0", "cc by",
    "creative commons", "cecill", "etalab", "datenlizenz", "the above copyright notice",
)

RULES = r"""
mit 4 1.0 spdx: spdx license identifier mit
mit-0 4 1.0 spdx: spdx license identifier mit 0
apache-2 4 1.0 spdx: spdx license identifier apache 2 0
apache-1 4 1.0 spdx: spdx license identifier apache 1 [01]
bsd-2 4 1.0 spdx: spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3 4 1.0 spdx: spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-4 4 1.0 spdx: spdx license identifier bsd 4 clause(?: uc)?
bsd-0 4 1.0 spdx: spdx license identifier 0bsd
gpl-1 4 1.0 spdx: spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 4 1.0 spdx: spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 4 1.0 spdx: spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 4 1.0 spdx: spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-3 4 1.0 spdx: spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 4 1.0 spdx: spdx license identifier agpl 3 0(?: only| or later)?
fdl 4 1.0 spdx: spdx license identifier gfdl 1 [123](?: only| or later)?
mpl-1 4 1.0 spdx: spdx license identifier mpl 1 [01]
mpl-2 4 1.0 spdx: spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1 4 1.0 spdx: spdx license identifier epl 1 0
epl-2 4 1.0 spdx: spdx license identifier epl 2 0
cddl 4 1.0 spdx: spdx license identifier cddl 1 [01]
eupl 4 1.0 spdx: spdx license identifier eupl 1 [012]
isc 4 1.0 spdx: spdx license identifier isc
zlib 4 1.0 spdx: spdx license identifier zlib
libpng 4 1.0 spdx: spdx license identifier libpng(?: 2 0)?
boost 4 1.0 spdx: spdx license identifier bsl 1 0
bsl 4 1.0 spdx: spdx license identifier busl 1 1
artistic-1 4 1.0 spdx: spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2 4 1.0 spdx: spdx license identifier artistic 2 0
unlicense 4 1.0 spdx: spdx license identifier unlicense
wtfpl 4 1.0 spdx: spdx license identifier wtfpl
cc0 4 1.0 spdx: spdx license identifier cc0 1 0
cc-by 4 1.0 spdx: spdx license identifier cc by [1234] [05]
cc-by-sa 4 1.0 spdx: spdx license identifier cc by sa [1234] [05]
cc-by-nd 4 1.0 spdx: spdx license identifier cc by nd [1234] [05]
cc-by-nc 4 1.0 spdx: spdx license identifier cc by nc [1234] [05]
cc-by-nc-sa 4 1.0 spdx: spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd 4 1.0 spdx: spdx license identifier cc by nc nd [1234] [05]
psf 4 1.0 spdx: spdx license identifier (?:psf|python) 2 0
php 4 1.0 spdx: spdx license identifier php 3 0[01]?
ruby 4 1.0 spdx: spdx license identifier ruby
openssl 4 1.0 spdx: spdx license identifier openssl
postgresql 4 1.0 spdx: spdx license identifier postgresql
ofl 4 1.0 spdx: spdx license identifier ofl 1 [01]
odbl 4 1.0 spdx: spdx license identifier odbl 1 0
odc-by 4 1.0 spdx: spdx license identifier odc by 1 0
ms-pl 4 1.0 spdx: spdx license identifier ms pl
ms-rl 4 1.0 spdx: spdx license identifier ms rl
ncsa 4 1.0 spdx: spdx license identifier ncsa
w3c 4 1.0 spdx: spdx license identifier w3c
vim 4 1.0 spdx: spdx license identifier vim
sspl 4 1.0 spdx: spdx license identifier sspl 1 0
elastic 4 1.0 spdx: spdx license identifier elastic 2 0
upl 4 1.0 spdx: spdx license identifier upl 1 0
mulan 4 1.0 spdx: spdx license identifier mulanpsl [12] 0
mit 4 0.95 osi approved: license osi approved mit license
apache-2 4 0.95 osi approved: license osi approved apache software license
bsd 4 0.95 osi approved: license osi approved bsd license
gpl-2 4 0.95 osi approved: license osi approved gnu general public license v2(?: or later)?(?: gplv2)?
gpl-3 4 0.95 osi approved: license osi approved gnu general public license v3(?: or later)?(?: gplv3)?
lgpl-2 4 0.95 osi approved: license osi approved gnu lesser general public license v2
lgpl-3 4 0.95 osi approved: license osi approved gnu lesser general public license v3
agpl-3 4 0.95 osi approved: license osi approved gnu affero general public license v3
mpl-2 4 0.95 osi approved: license osi approved mozilla public license 2 0
isc 4 0.95 osi approved: license osi approved isc license
psf 4 0.95 osi approved: license osi approved python software foundation license
zlib 4 0.95 osi approved: license osi approved zlib libpng license
artistic 4 0.95 osi approved: license osi approved artistic license
eupl 4 0.95 osi approved: license osi approved european union public licence
mit 3 0.95 hereby granted: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 3 0.9 hereby granted: permission is hereby granted free of charge to any person obtaining a copy
mit 3 0.8 this permission notice: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit 3 0.7 without warranty of any kind: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11 3 0.8 x consortium: except as contained in this notice the name of the x consortium shall not be used in advertising
isc 3 0.95 permission to use: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 3 0.8 permission to use: permission to use copy modify and or distribute this software for any purpose
hpnd 3 0.8 permission to use: permission to use copy modify and distribute this software and its documentation for any purpose
bsd 3 0.9 redistribution and use: redistribution and use in source and binary forms with or without modification are permitted
bsd 3 0.8 redistribution and use: redistribution and use in source and binary forms with or without modification
bsd-3 3 0.95 endorse or promote: neither the name of .{1,80}? may be used to endorse or promote products derived from this software
bsd-3 3 0.9 endorse or promote: the name of the author may not be used to endorse or promote products derived from this software
bsd-4 3 0.95 advertising materials: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd 3 0.8 must retain: redistributions of source code must retain the above copyright notice this list of conditions
bsd 3 0.8 must reproduce: redistributions in binary form must reproduce the above copyright notice
gpl 3 0.95 free software: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2 3 0.95 free software+either version 2: is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl-3 3 0.95 free software+either version 3: is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
lgpl 3 0.95 free software: this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl 3 0.95 free software: this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl 3 0.7 merchantability: is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness
gpl 3 0.8 received a copy: you should have received a copy of the gnu general public license
lgpl 3 0.8 received a copy: you should have received a copy of the gnu (?:lesser|library) general public license
agpl 3 0.8 received a copy: you should have received a copy of the gnu affero general public license
gpl 3 0.8 everyone is permitted: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
agpl-3 3 0.8 remote network interaction: remote network interaction use with the gnu general public license
fdl 3 0.9 free documentation: under the terms of the gnu free documentation license version 1 [123]
fdl 3 0.8 invariant sections: with no invariant sections no front cover texts and no back cover texts
apache-2 3 0.95 may not use this file: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 3 0.8 compliance with the license: you may not use this file except in compliance with the license
apache-2 3 0.8 limitations under the license: see the license for the specific language governing permissions and limitations under the license
apache-2 3 0.9 apache: apache license version 2 0 january 2004
apache-1 3 0.9 apache: this product includes software developed by the apache (?:group|software foundation)
mpl-2 3 0.95 source code form: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 3 0.8 mpl was not: if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1 3 0.95 mozilla: the contents of this file are subject to the mozilla public license version 1 [01]
epl-1 3 0.95 eclipse: made available under the terms of the eclipse public license v1 0
epl-2 3 0.95 eclipse: made available under the terms of the eclipse public license(?: v| version)? ?2 0
cddl 3 0.95 common development: the contents of this file are subject to the terms of the common development and distribution license
cpl 3 0.95 common public: made available under the terms of the common public license v1 0
unlicense 3 0.95 unencumbered: this is free and unencumbered software released into the public domain
unlicense 3 0.8 anyone is free: anyone is free to copy modify publish use compile sell or distribute this software
zlib 3 0.95 held liable: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 3 0.9 must not be misrepresented: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib 3 0.8 plainly marked: altered source versions must be plainly marked as such
boost 3 0.95 boost software: boost software license version 1 0 august 17th 2003
boost 3 0.9 hereby granted: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
wtfpl 3 0.95 what the fuck: you just do what the fuck you want to
wtfpl 3 0.95 what the fuck: do what the fuck you want to public license
cc0 3 0.95 to the extent possible: to the extent possible under law .{1,80}? waived all copyright
cc0 3 0.9 creative commons: creative commons (?:legal code )?cc0 1 0 universal
artistic-2 3 0.9 artistic: the artistic license 2 0 copyright
artistic-1 3 0.9 intent of this document: the intent of this document is to state the conditions under which a package may be copied
psf 3 0.9 making python available: psf is making python available to licensee on an as is basis
php 3 0.9 php: this product includes php software freely available from
openssl 3 0.9 openssl: this product includes software developed by the openssl project
postgresql 3 0.9 postgresql: postgresql database management system formerly known as postgres
ofl 3 0.95 font software: this font software is licensed under the sil open font license version 1 1
ofl 3 0.8 reserved font name: reserved font name refers to any names specified as such after the copyright statement
odbl 3 0.9 database: this .{1,60}? is made available under the open database license
odc-by 3 0.9 open data commons: is made available under the open data commons attribution license
ms-pl 3 0.9 accompanying software: this license governs use of the accompanying software if you use the software you accept this license
ncsa 3 0.9 permission is hereby: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
w3c 3 0.9 by obtaining using: by obtaining using and or copying this work you the licensee agree
vim 3 0.9 vim: there are no restrictions on distributing unmodified copies of vim
sspl 3 0.9 server side: server side public license version 1 october 16 2018
elastic 3 0.9 managed service: you may not provide the software to third parties as a hosted or managed service
bsl 3 0.9 business source: the business source license this document or the license is not an open source license
beerware 3 0.9 beer: if we meet some day and you think this stuff is worth it you can buy me a beer in return
json 3 0.9 used for good: the software shall be used for good not evil
curl 3 0.9 many contributors: copyright .{1,80}? and many contributors see the thanks file
ijg 3 0.9 jpeg group: this software is based in part on the work of the independent jpeg group
freetype 3 0.9 freetype: portions of this software are copyright .{1,40}? the freetype project
imagemagick 3 0.9 imagemagick: the imagemagick license
sleepycat 3 0.9 complete source code: redistributions in any form must be accompanied by information on how to obtain complete source code
public-domain 3 0.9 public domain: (?:has been|is|are|was) (?:hereby )?(?:dedicated|released|placed) (?:to|into|in) the public domain
public-domain 3 0.9 public domain: (?:dedicated|released|placed) (?:to|into|in) the public domain
all-rights-reserved 3 0.5 rights reserved: all rights reserved
proprietary 3 0.7 confidential: (?:proprietary and confidential|confidential and proprietary)
proprietary 3 0.7 unauthorized: unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document) .{0,60}?is strictly prohibited
proprietary 3 0.6 trade secret: contains (?:confidential information and )?trade secrets of
no-redistribution 3 0.6 written permission: may not be (?:copied|reproduced|redistributed)(?: or \w+)? without (?:the )?(?:prior )?written permission
mit 2 0.95 mit: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: public| x11| expat)?(?: licen[cs]e)?
mit 2 0.9 mit: under (?:the )?terms of (?:the )?mit licen[cs]e
mit 2 0.85 mit: (?:subject to|governed by|covered by) (?:the )?mit licen[cs]e
mit 2 0.9 expat: (?:licensed|released|distributed|available) under (?:the )?expat licen[cs]e
mit 2 0.9 x11: (?:licensed|released|distributed|available) under (?:the )?x11 licen[cs]e
mit 2 0.8 opensource: opensource org licenses mit(?: license)?(?: php| html)?
apache-2 2 0.95 apache: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?
apache-2 2 0.9 apache: under (?:the )?terms of (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 2 0.85 apache: (?:subject to|governed by|covered by) (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 2 0.8 apache: (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1 2 0.9 apache: (?:licensed|released|distributed|available) under (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?1(?: [01])?
apache 2 0.8 apache: (?:licensed|released|distributed|available) under (?:the )?apache(?: software)? licen[cs]e
bsd 2 0.9 bsd: (?:licensed|released|distributed|published|available|provided) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)?(?: licen[cs]e)?
bsd-2 2 0.95 bsd: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2 2 0.95 bsd: (?:licensed|released|distributed|available) under (?:the )?bsd 2 clause(?: licen[cs]e)?
bsd-3 2 0.95 bsd: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:modified|new|revised|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3 2 0.95 bsd: (?:licensed|released|distributed|available) under (?:the )?bsd 3 clause(?: licen[cs]e)?
bsd-4 2 0.95 bsd: (?:licensed|released|distributed|available) under (?:the )?(?:original|4 clause) bsd(?: licen[cs]e)?
bsd 2 0.85 bsd: (?:subject to|governed by|covered by|under the terms of) (?:the |a )?bsd(?: style)? licen[cs]e
gpl 2 0.9 gpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: licen[cs]e)?
gpl-1 2 0.95 gpl: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?: version| v)? ?1(?: 0)?
gpl-2 2 0.95 gpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: or later)?
gpl-3 2 0.95 gpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: or later)?
gpl 2 0.9 general public: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e
gpl-2 2 0.95 general public: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?
gpl-3 2 0.95 general public: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?
gpl 2 0.85 general public: (?:subject to|governed by|covered by|under the terms of) (?:the )?(?:gnu )?general public licen[cs]e
gpl 2 0.7 gnu: (?:www )?gnu org licenses(?: old licenses)? gpl(?: [123] 0)?(?: txt| html)?
lgpl 2 0.9 lgpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:gnu )?lgpl
lgpl-2 2 0.95 lgpl: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version| v)? ?2(?: [01])?
lgpl-3 2 0.95 lgpl: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?
lgpl 2 0.9 general public: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-2 2 0.95 general public: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?2(?: [01])?
lgpl-3 2 0.95 general public: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?
lgpl 2 0.7 gnu: (?:www )?gnu org licenses(?: old licenses)? lgpl(?: [123] [01])?(?: txt| html)?
agpl-3 2 0.95 agpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:gnu )?agpl(?: version| v)? ?3(?: 0)?
agpl 2 0.9 agpl: (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:gnu )?agpl
agpl-3 2 0.95 affero: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?
agpl 2 0.9 affero: (?:licensed|released|distributed|available|under the terms of) (?:under )?(?:the )?(?:gnu )?affero general public licen[cs]e
fdl 2 0.9 free documentation: (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?free documentation licen[cs]e
mpl-1 2 0.95 mozilla: (?:licensed|released|distributed|available) under (?:the )?mozilla public licen[cs]e(?: version| v)? ?1(?: [01])?
mpl-2 2 0.95 mozilla: (?:licensed|released|distributed|published|available|provided) under (?:the )?mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-2 2 0.9 mpl: (?:licensed|released|distributed|available) under (?:the )?mpl(?: version| v)? ?2(?: 0)?
mpl 2 0.85 mozilla: (?:subject to|governed by|covered by|under the terms of) (?:the )?mozilla public licen[cs]e
mpl 2 0.7 mozilla: (?:www )?mozilla org mpl(?: 2 0| mpl 1 1)?(?: html| txt)?
epl-1 2 0.95 eclipse: (?:licensed|released|distributed|available) under (?:the )?eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl-2 2 0.95 eclipse: (?:licensed|released|distributed|available) under (?:the )?eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
epl 2 0.85 eclipse: (?:subject to|governed by|covered by|licensed under|under the terms of) (?:the )?eclipse public licen[cs]e
epl 2 0.7 eclipse: (?:www )?eclipse org legal epl (?:v10|2 0)(?: html)?
cddl 2 0.9 cddl: (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?cddl(?: 1 [01])?
cddl 2 0.9 common development: (?:licensed|released|distributed|available) under (?:the )?common development and distribution licen[cs]e
eupl 2 0.9 eupl: (?:licensed|released|distributed|available) under (?:the )?eupl(?: v)?(?: ?1 [012])?
eupl 2 0.9 european union: (?:licensed|released|distributed|available) under (?:the )?european union public licen[cs]e(?: v)?(?: ?1 [012])?
isc 2 0.9 isc: (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
zlib 2 0.9 zlib: (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: licen[cs]e)?
libpng 2 0.9 libpng: (?:licensed|released|distributed|available) under (?:the )?libpng licen[cs]e
boost 2 0.95 boost: (?:licensed|released|distributed|available|provided) under (?:the )?boost(?: software)? licen[cs]e(?: version)?(?: 1 0)?
boost 2 0.7 boost: (?:www )?boost org license 1 0(?: txt)?
artistic 2 0.85 artistic: (?:licensed|released|distributed|available) under (?:the )?(?:perl )?artistic licen[cs]e
artistic-2 2 0.95 artistic: (?:licensed|released|distributed|available) under (?:the )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?
perl 2 0.9 same terms: under the same terms as perl itself
unlicense 2 0.9 unlicense: (?:licensed|released|distributed|available) under (?:the )?unlicense
unlicense 2 0.8 unlicense: (?:please refer to )?(?:http |https )?unlicense org
wtfpl 2 0.9 wtfpl: (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?wtfpl
cc0 2 0.95 cc0: (?:licensed|released|distributed|published|available|dedicated) under (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?
cc0 2 0.8 publicdomain: creativecommons org publicdomain zero 1 0
cc-by 2 0.95 cc by: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?(?:terms of )?(?:the )?cc by(?: [1234] [05])?(?: licen[cs]e)?
cc-by-sa 2 0.95 cc by sa: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?(?:terms of )?(?:the )?cc by sa(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nd 2 0.95 cc by nd: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?cc by nd(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nc 2 0.95 cc by nc: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?cc by nc(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nc-sa 2 0.95 cc by nc sa: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?cc by nc sa(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nc-nd 2 0.95 cc by nc nd: (?:licensed|released|distributed|published|available|provided|shared) under (?:the |a )?cc by nc nd(?: [1234] [05])?(?: licen[cs]e)?
cc-by 2 0.95 creative commons attribution: (?:licensed|released|published|available|shared) under (?:the |a )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa 2 0.95 creative commons attribution: creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd 2 0.95 creative commons attribution: creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc 2 0.95 creative commons attribution: creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa 2 0.95 creative commons attribution: creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd 2 0.95 creative commons attribution: creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by 2 0.8 creativecommons: creativecommons org licenses by [1234] [05]
cc-by-sa 2 0.8 creativecommons: creativecommons org licenses by sa [1234] [05]
cc-by-nd 2 0.8 creativecommons: creativecommons org licenses by nd [1234] [05]
cc-by-nc 2 0.8 creativecommons: creativecommons org licenses by nc [1234] [05]
cc-by-nc-sa 2 0.8 creativecommons: creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd 2 0.8 creativecommons: creativecommons org licenses by nc nd [1234] [05]
psf 2 0.9 psf: (?:licensed|released|distributed|available) under (?:the )?psf licen[cs]e
psf 2 0.9 python software: (?:licensed|released|distributed|available) under (?:the )?python software foundation licen[cs]e
php 2 0.9 php: (?:licensed|released|distributed|available|subject to|under) (?:under )?(?:the )?(?:version 3 0[01]? of the )?php licen[cs]e
ruby 2 0.9 ruby: (?:licensed|released|distributed|available) under (?:the )?(?:same terms as )?ruby(?: licen[cs]e)?
openssl 2 0.9 openssl: (?:licensed|released|distributed|available) under (?:the )?openssl licen[cs]e
postgresql 2 0.9 postgresql: (?:licensed|released|distributed|available) under (?:the )?postgresql licen[cs]e
ofl 2 0.9 open font: (?:licensed|released|distributed|available) under (?:the )?(?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?
odbl 2 0.9 open database: (?:licensed|released|distributed|available) under (?:the )?(?:open data commons )?open database licen[cs]e
odbl 2 0.8 odbl: (?:licensed|released|distributed|available) under (?:the )?odbl
odc-by 2 0.8 opendatacommons: opendatacommons org licenses by 1 0
odbl 2 0.8 opendatacommons: opendatacommons org licenses odbl 1 0
ms-pl 2 0.9 microsoft: (?:licensed|released|distributed|available|governed by|subject to) (?:under )?(?:the )?microsoft public licen[cs]e
ms-rl 2 0.9 microsoft: (?:licensed|released|distributed|available|governed by|subject to) (?:under )?(?:the )?microsoft reciprocal licen[cs]e
ncsa 2 0.9 ncsa: (?:licensed|released|distributed|available) under (?:the )?(?:university of illinois )?ncsa(?: open source)?(?: licen[cs]e)?
w3c 2 0.9 w3c: (?:licensed|released|distributed|available) under (?:the )?w3c(?: software)?(?: licen[cs]e| notice)?
vim 2 0.9 vim: (?:licensed|released|distributed|available) under (?:the )?vim licen[cs]e
bsl 2 0.9 business source: (?:licensed|released|distributed|available) under (?:the )?business source licen[cs]e(?: 1 1)?
sspl 2 0.9 server side: (?:licensed|released|distributed|available) under (?:the )?server side public licen[cs]e
sspl 2 0.9 sspl: (?:licensed|released|distributed|available) under (?:the )?sspl
elastic 2 0.9 elastic: (?:licensed|released|distributed|available) under (?:the )?elastic licen[cs]e(?: 2 0)?
upl 2 0.9 universal permissive: (?:licensed|released|distributed|available) under (?:the )?universal permissive licen[cs]e
mulan 2 0.9 mulan: (?:licensed|released|distributed|available) under (?:the )?mulan(?: permissive software licen[cs]e| psl)(?: v?[12])?
ecl 2 0.9 educational community: (?:licensed|released|distributed|available) under (?:the )?educational community licen[cs]e(?: version)?(?: 2 0)?
afl 2 0.9 academic free: (?:licensed|released|distributed|available) under (?:the )?academic free licen[cs]e(?: version)?(?: 3 0)?
osl 2 0.9 open software: (?:licensed|released|distributed|available) under (?:the )?open software licen[cs]e(?: version)?(?: 3 0)?
cecill 2 0.9 cecill: (?:licensed|released|distributed|available|governed by) (?:under )?(?:the )?cecill(?: [bc])?(?: licen[cs]e)?
ogl-uk 2 0.9 open government: (?:licensed|released|published|available|contains information licensed) under (?:the )?open government licen[cs]e(?: v3 0| v2 0)?
etalab 2 0.9 etalab: (?:licence ouverte|open licence) etalab(?: [12] 0)?
dl-de 2 0.9 datenlizenz: datenlizenz deutschland (?:namensnennung|zero)(?: version)? ?2 0
public-domain 2 0.8 public domain: (?:this work is|is|are) in the public domain
mit 1 0.7 mit: (?:the )?mit licen[cs]e
mit 1 0.6 mit: licen[cs]e (?:is )?mit
mit 1 0.7 expat: (?:the )?expat licen[cs]e
mit 1 0.7 x11: (?:the )?x11 licen[cs]e
apache-2 1 0.7 apache: (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 1 0.7 apache: (?:the )?apache(?: version| v)? ?2(?: 0)? licen[cs]e
apache-2 1 0.6 apache: licen[cs]e (?:is )?apache(?: version| v)? ?2(?: 0)?
apache-1 1 0.7 apache: (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?1(?: [01])?
apache 1 0.6 apache: (?:the )?apache(?: software)? licen[cs]e
bsd-2 1 0.7 bsd: (?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) licen[cs]e
bsd-3 1 0.7 bsd: (?:the )?(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e
bsd-4 1 0.7 bsd: (?:the )?(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e
bsd 1 0.6 bsd: (?:the )?bsd(?: style)? licen[cs]e
bsd 1 0.6 bsd: licen[cs]e (?:is )?bsd
gpl-2 1 0.7 gpl: (?:the )?(?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: licen[cs]e)?
gpl-3 1 0.7 gpl: (?:the )?(?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: licen[cs]e)?
gpl 1 0.6 gpl: (?:the )?(?:gnu )?gpl licen[cs]e
gpl-2 1 0.7 general public: (?:the )?(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?
gpl-3 1 0.7 general public: (?:the )?(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?
gpl 1 0.6 general public: (?:the )?gnu general public licen[cs]e
lgpl-2 1 0.7 lgpl: (?:the )?(?:gnu )?lgpl(?: version| v)? ?2(?: [01])?(?: licen[cs]e)?
lgpl-3 1 0.7 lgpl: (?:the )?(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?(?: licen[cs]e)?
lgpl 1 0.6 general public: (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
agpl-3 1 0.7 agpl: (?:the )?(?:gnu )?agpl(?: version| v)? ?3(?: 0)?(?: licen[cs]e)?
agpl 1 0.6 affero: (?:the )?(?:gnu )?affero general public licen[cs]e
fdl 1 0.6 free documentation: (?:the )?(?:gnu )?free documentation licen[cs]e
mpl-2 1 0.7 mozilla: (?:the )?mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?
mpl-1 1 0.7 mozilla: (?:the )?mozilla public licen[cs]e(?: version| v)? ?1(?: [01])?
mpl 1 0.6 mozilla: (?:the )?mozilla public licen[cs]e
epl 1 0.6 eclipse: (?:the )?eclipse public licen[cs]e(?: version| v)?(?: ?[12] 0)?
cddl 1 0.6 common development: (?:the )?common development and distribution licen[cs]e(?: 1 [01])?
cpl 1 0.6 common public: (?:the )?common public licen[cs]e(?: 1 0)?
eupl 1 0.6 european union: (?:the )?european union public licen[cs]e(?: v)?(?: ?1 [012])?
isc 1 0.6 isc: (?:the )?isc licen[cs]e
zlib 1 0.6 zlib: (?:the )?zlib(?: libpng)? licen[cs]e
boost 1 0.6 boost: (?:the )?boost(?: software)? licen[cs]e(?: 1 0)?
artistic 1 0.6 artistic: (?:the )?(?:perl )?artistic licen[cs]e
artistic-2 1 0.7 artistic: (?:the )?artistic licen[cs]e(?: version| v)? ?2(?: 0)?
wtfpl 1 0.6 wtfpl: (?:the )?wtfpl(?: licen[cs]e)?
cc0 1 0.7 cc0: (?:the )?cc0(?: 1 0)?(?: universal)? (?:licen[cs]e|public domain dedication)
cc-by 1 0.7 cc by: (?:the )?cc by(?: [1234] [05])? licen[cs]e
cc-by-sa 1 0.7 cc by sa: (?:the )?cc by sa(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nd 1 0.7 cc by nd: (?:the )?cc by nd(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nc-sa 1 0.7 cc by nc sa: (?:the )?cc by nc sa(?: [1234] [05])?(?: licen[cs]e)?
cc-by-nc-nd 1 0.7 cc by nc nd: (?:the )?cc by nc nd(?: [1234] [05])?(?: licen[cs]e)?
cc-by 1 0.6 creative commons: (?:the )?creative commons attribution licen[cs]e
cc 1 0.5 creative commons: (?:a |the )?creative commons licen[cs]e
psf 1 0.6 psf: (?:the )?psf licen[cs]e
php 1 0.6 php: (?:the )?php licen[cs]e
openssl 1 0.6 openssl: (?:the )?openssl licen[cs]e
ofl 1 0.6 open font: (?:the )?(?:sil )?open font licen[cs]e(?: 1 [01])?
odbl 1 0.6 open database: (?:the )?open database licen[cs]e
ms-pl 1 0.6 microsoft: (?:the )?microsoft public licen[cs]e
ms-rl 1 0.6 microsoft: (?:the )?microsoft reciprocal licen[cs]e
ncsa 1 0.6 ncsa: (?:the )?(?:university of illinois )?ncsa(?: open source)? licen[cs]e
bsl 1 0.6 business source: (?:the )?business source licen[cs]e(?: 1 1)?
sspl 1 0.6 server side: (?:the )?server side public licen[cs]e
ogl-uk 1 0.6 open government: (?:the )?open government licen[cs]e
"""
