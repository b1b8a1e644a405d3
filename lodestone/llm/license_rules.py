"""License signatures, the most specific first: a rule earlier in the list wins over later ones.

Each line is ``label | weight | keyword | expression``. Texts are compared as
lower-cased words joined by single spaces, with a space at either end, so
``GPL-3.0`` reads ``gpl 3 0``. The expression must begin and end at a word; the
keyword is a plain part of any text that it can match and gates it.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that every scan counts, whatever else it finds.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Every match has one of these words; texts without any are not looked at.
GATES = (
    "license", "licence", "licensed", "licenced", "licenses", "unlicense", "public", "copyright", "publicdomain",
    "gpl", "gplv2", "gplv3", "lgpl", "lgplv3", "lgpl3", "lgplv2", "lgpl2", "agpl", "agplv3", "spdx", "cc", "cc0", "commons", "hereby",
    "redistribute", "redistribution", "promote", "software", "warranty", "apache", "bsd", "0bsd", "mpl", "zlib",
    "sspl", "eupl", "ofl", "odbl", "wtfpl", "cecill",
)

RULES = r"""
agpl-3.0-or-later | .99 | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0-only | .99 | spdx | spdx license identifier agpl 3 0 only
agpl-3.0 | .99 | spdx | spdx license identifier agpl 3 0
lgpl-3.0-or-later | .99 | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | .99 | spdx | spdx license identifier lgpl 3 0 only
lgpl-2.1-or-later | .99 | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | .99 | spdx | spdx license identifier lgpl 2 1 only
lgpl-2.0-or-later | .99 | spdx | spdx license identifier lgpl 2 0 or later
lgpl-2.0-only | .99 | spdx | spdx license identifier lgpl 2 0 only
gpl-3.0-or-later | .99 | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-only | .99 | spdx | spdx license identifier gpl 3 0 only
gpl-3.0 | .99 | spdx | spdx license identifier gpl 3 0
gpl-2.0-or-later | .99 | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-only | .99 | spdx | spdx license identifier gpl 2 0 only
gpl-2.0 | .99 | spdx | spdx license identifier gpl 2 0
gpl-1.0-or-later | .99 | spdx | spdx license identifier gpl 1 0 or later
apache-2.0 | .99 | spdx | spdx license identifier apache 2 0
apache-1.1 | .99 | spdx | spdx license identifier apache 1 1
mit-0 | .99 | spdx | spdx license identifier mit 0
mit | .99 | spdx | spdx license identifier mit
bsd-4-clause | .99 | spdx | spdx license identifier bsd 4 clause
bsd-3-clause | .99 | spdx | spdx license identifier bsd 3 clause
bsd-2-clause | .99 | spdx | spdx license identifier bsd 2 clause
bsd-1-clause | .99 | spdx | spdx license identifier bsd 1 clause
0bsd | .99 | spdx | spdx license identifier 0bsd
isc | .99 | spdx | spdx license identifier isc
zlib | .99 | spdx | spdx license identifier zlib
mpl-2.0 | .99 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | .99 | spdx | spdx license identifier mpl 1 1
epl-2.0 | .99 | spdx | spdx license identifier epl 2 0
epl-1.0 | .99 | spdx | spdx license identifier epl 1 0
cddl-1.0 | .99 | spdx | spdx license identifier cddl 1 0
bsl-1.0 | .99 | spdx | spdx license identifier bsl 1 0
unlicense | .99 | spdx | spdx license identifier unlicense
wtfpl | .99 | spdx | spdx license identifier wtfpl
cc0-1.0 | .99 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | .99 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | .99 | spdx | spdx license identifier cc by sa 4 0
eupl-1.2 | .99 | spdx | spdx license identifier eupl 1 2
ofl-1.1 | .99 | spdx | spdx license identifier ofl 1 1
artistic-2.0 | .99 | spdx | spdx license identifier artistic 2 0
sspl-1.0 | .99 | spdx | spdx license identifier sspl 1 0
agpl-3.0-or-later | .97 | gnu affero | gnu affero general public license(?: as published by the free software foundation)? (?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
agpl-3.0 | .96 | gnu affero | gnu affero general public license v(?:ersion )?3(?: 0)?
agpl-1.0 | .95 | affero | affero general public license v(?:ersion )?1(?: 0)?
agpl | .92 | gnu affero | gnu affero general public license
agpl-3.0 | .92 | agpl | agplv3
agpl-3.0 | .92 | agpl | agpl v?3(?: 0)?
agpl | .80 | agpl | agpl
lgpl-3.0-or-later | .97 | gnu lesser | gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
lgpl-2.1-or-later | .97 | gnu lesser | gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1 (?:of the license )?or (?:at your option )?any later version
lgpl-3.0 | .96 | gnu lesser | gnu lesser general public license v(?:ersion )?3(?: 0)?
lgpl-2.1 | .96 | gnu lesser | gnu lesser general public license v(?:ersion )?2 1
lgpl-2.0 | .96 | gnu library | gnu library general public license v(?:ersion )?2(?: 0)?
lgpl | .92 | gnu lesser | gnu lesser general public license
lgpl-2.0 | .90 | gnu library | gnu library general public license
lgpl-3.0 | .92 | lgpl | lgpl ?v?3(?: 0)?
lgpl-2.1 | .92 | lgpl | lgpl ?v?2 1
lgpl | .80 | lgpl | lgpl
gfdl-1.3 | .96 | gnu free documentation | gnu free documentation license v(?:ersion )?1 3
gfdl-1.2 | .96 | gnu free documentation | gnu free documentation license v(?:ersion )?1 2
gfdl-1.1 | .96 | gnu free documentation | gnu free documentation license v(?:ersion )?1 1
gfdl | .92 | gnu free documentation | gnu free documentation license
gpl-3.0-or-later | .97 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-or-later | .97 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
gpl-1.0-or-later | .97 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? (?:either )?version 1 (?:of the license )?or (?:at your option )?any later version
gpl-3.0 | .96 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? v(?:ersion )?3(?: 0)?
gpl-2.0 | .96 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? v(?:ersion )?2(?: 0)?
gpl-1.0 | .96 | gnu general public licen | gnu general public licen[cs]e(?: as published by the free software foundation)? v(?:ersion )?1(?: 0)?
gpl | .85 | gnu gpl | gnu gpl
gpl-3.0 | .90 | gplv3 | gplv3
gpl-2.0 | .90 | gplv2 | gplv2
gpl-3.0 | .90 | gpl | gpl v?(?:ersion )?3(?: 0)?
gpl-2.0 | .90 | gpl | gpl v?(?:ersion )?2(?: 0)?
gpl | .80 | licen | licen[cs]ed under (?:the )?(?:terms of the )?gpl
apache-2.0 | .97 | apache licen | apache licen[cs]e v(?:ersion )?2(?: 0)?
apache-1.1 | .97 | apache | apache software license v(?:ersion )?1 1
apache-1.0 | .97 | apache | apache software license v(?:ersion )?1 0
apache-1.1 | .96 | apache licen | apache licen[cs]e v(?:ersion )?1 1
apache-2.0 | .96 | licenses license 2 0 | apache org licenses license 2 0
apache-2.0 | .95 | may not use this file except in compliance with the licen | you may not use this file except in compliance with the licen[cs]e
apache-2.0 | .90 | apache 2 0 | apache 2 0
mit-0 | .96 | mit no attribution licen | mit no attribution licen[cs]e
mit | .97 | hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | .90 | mit licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[cs]e
mit | .90 | licenses mit | opensource org licenses mit(?: license)?(?: php)?
x11 | .92 | x11 licen | x11 licen[cs]e
mit-modern | .90 | hereby granted | permission is hereby granted without written agreement and without license or royalty fees
expat | .90 | expat licen | expat licen[cs]e
bsd-4-clause | .96 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | .96 | endorse or promote products | neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software
bsd-2-clause | .90 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause | .94 | bsd | (?:original|old) bsd license
bsd-4-clause | .94 | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | .94 | bsd | bsd (?:4|four) clause(?: license)?
bsd-3-clause | .94 | bsd | (?:new|modified|revised) bsd license
bsd-3-clause | .94 | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | .94 | bsd | bsd (?:3|three) clause(?: license)?
bsd-2-clause | .94 | bsd | (?:simplified|freebsd) bsd license
bsd-2-clause | .94 | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | .94 | bsd | bsd (?:2|two) clause(?: license)?
bsd-1-clause | .94 | bsd | (?:1|one) clause bsd(?: license)?
0bsd | .94 | bsd | (?:0|zero) clause bsd(?: license)?
0bsd | .90 | 0bsd | 0bsd
bsd | .85 | bsd licen | bsd licen[cs]ed?
bsd | .80 | bsd style licen | bsd style licen[cs]e
isc | .95 | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | .90 | isc licen | isc licen[cs]e
hpnd | .90 | is hereby granted without fee | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose is hereby granted without fee
mpl-2.0 | .97 | mozilla public licen | mozilla public licen[cs]e v(?:ersion )?2(?: 0)?
mpl-1.1 | .97 | mozilla public licen | mozilla public licen[cs]e v(?:ersion )?1 1
mpl-1.0 | .97 | mozilla public licen | mozilla public licen[cs]e v(?:ersion )?1 0
mpl | .90 | mozilla public licen | mozilla public licen[cs]e
mpl-2.0 | .85 | mpl | mpl v?2(?: 0)?
mpl-1.1 | .85 | mpl | mpl v?1 1
npl-1.1 | .92 | netscape public licen | netscape public licen[cs]e(?: version 1 1)?
epl-2.0 | .97 | eclipse public licen | eclipse public licen[cs]e v(?:ersion )?2(?: 0)?
epl-1.0 | .97 | eclipse public licen | eclipse public licen[cs]e v(?:ersion )?1(?: 0)?
epl | .90 | eclipse public licen | eclipse public licen[cs]e
edl-1.0 | .92 | eclipse distribution licen | eclipse distribution licen[cs]e(?: v(?:ersion )?1 0)?
cpl-1.0 | .92 | common public licen | common public licen[cs]e(?: v(?:ersion )?1 0)?
ipl-1.0 | .92 | ibm public licen | ibm public licen[cs]e(?: v(?:ersion )?1 0)?
cddl-1.1 | .97 | common development and distribution licen | common development and distribution licen[cs]e (?:cddl )?v(?:ersion )?1 1
cddl-1.0 | .97 | common development and distribution licen | common development and distribution licen[cs]e (?:cddl )?v(?:ersion )?1 0
cddl | .90 | common development and distribution licen | common development and distribution licen[cs]e
cpal-1.0 | .92 | common public attribution licen | common public attribution licen[cs]e(?: v(?:ersion )?1 0)?
osl-3.0 | .95 | open software licen | open software licen[cs]e v(?:ersion )?(?:\. )?3 0
osl | .88 | open software licen | open software licen[cs]e
afl-3.0 | .95 | academic free licen | academic free licen[cs]e v(?:ersion )?3 0
afl-2.1 | .95 | academic free licen | academic free licen[cs]e v(?:ersion )?2 1
afl | .88 | academic free licen | academic free licen[cs]e
artistic-2.0 | .96 | artistic licen | artistic licen[cs]e v?(?:ersion )?2(?: 0)?
artistic-1.0 | .96 | artistic licen | artistic licen[cs]e v?(?:ersion )?1(?: 0)?
artistic | .88 | artistic licen | artistic licen[cs]e
perl-terms | .88 | redistribut | (?:you can|may) redistribute it and or modify it under the same terms as perl itself
bsl-1.0 | .96 | boost software licen | boost software licen[cs]e(?: v(?:ersion )?1 0)?
busl-1.1 | .95 | business source licen | business source licen[cs]e(?: v?(?:ersion )?1 1)?
elastic-2.0 | .95 | elastic licen | elastic licen[cs]e(?: v?(?:ersion )?2(?: 0)?)?
sspl-1.0 | .95 | server side public licen | server side public licen[cs]e(?: v?(?:ersion )?1)?
sspl-1.0 | .85 | sspl | sspl
zlib | .95 | provided as is without any express or implied warrant | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | .88 | zlib licen | zlib licen[cs]e
zlib | .88 | zlib libpng licen | zlib libpng licen[cs]e
libpng | .88 | libpng licen | libpng licen[cs]e
openssl | .90 | openssl licen | openssl licen[cs]e
openssl | .92 | for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit http www openssl org licen[cs]e
ssleay | .85 | ssleay licen | ssleay licen[cs]e
postgresql | .92 | postgresql licen | postgresql licen[cs]e
ncsa | .92 | illinois ncsa open source licen | (?:university of )?illinois ncsa open source licen[cs]e
ncsa | .88 | ncsa licen | ncsa licen[cs]e
php-3.01 | .95 | php licen | php licen[cs]e v(?:ersion )?3 01
php-3.0 | .95 | php licen | php licen[cs]e v(?:ersion )?3 0
php | .85 | php licen | php licen[cs]e
python-2.0 | .93 | python software foundation licen | python software foundation licen[cs]e(?: v(?:ersion )?2)?
python-2.0 | .85 | psf licen | psf licen[cs]e
cnri-python | .88 | cnri python licen | cnri python licen[cs]e
ruby | .85 | ruby licen | ruby licen[cs]e
tcl | .85 | tcl tk licen | tcl tk licen[cs]e
vim | .85 | vim licen | vim licen[cs]e
zpl-2.1 | .93 | zope public licen | zope public licen[cs]e v(?:ersion )?2 1
zpl | .88 | zope public licen | zope public licen[cs]e
w3c | .90 | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e
unicode | .90 | unicode inc licen | unicode inc licen[cs]e agreement
icu | .85 | icu licen | icu licen[cs]e
curl | .82 | curl licen | curl licen[cs]e
lppl-1.3c | .93 | latex project public licen | latex project public licen[cs]e(?: v(?:ersion )?1 3c?)?
ofl-1.1 | .95 | sil open font licen | sil open font licen[cs]e(?: v(?:ersion )?1 1)?
ofl | .80 | ofl | ofl v?1 [01]
ecl-2.0 | .92 | educational community licen | educational community licen[cs]e(?: v(?:ersion )?2 0)?
upl-1.0 | .92 | universal permissive licen | universal permissive licen[cs]e(?: v(?:ersion )?1 0)?
ms-pl | .93 | microsoft public licen | microsoft public licen[cs]e(?: ms pl)?
ms-rl | .93 | microsoft reciprocal licen | microsoft reciprocal licen[cs]e(?: ms rl)?
apsl-2.0 | .92 | apple public source licen | apple public source licen[cs]e(?: v(?:ersion )?2 0)?
sissl | .90 | sun industry standards source licen | sun industry standards source licen[cs]e
spl-1.0 | .90 | sun public licen | sun public licen[cs]e(?: v(?:ersion )?1 0)?
qpl-1.0 | .90 | q public licen | q public licen[cs]e(?: v(?:ersion )?1 0)?
rpl-1.5 | .90 | reciprocal public licen | reciprocal public licen[cs]e(?: 1 5)?
sleepycat | .88 | sleepycat licen | sleepycat licen[cs]e
watcom-1.0 | .88 | sybase open watcom public licen | sybase open watcom public licen[cs]e(?: v(?:ersion )?1 0)?
eupl-1.2 | .95 | european union public licen | european union public licen[cs]e v(?:ersion )?(?:\. )?1 2
eupl-1.1 | .95 | european union public licen | european union public licen[cs]e v(?:ersion )?(?:\. )?1 1
eupl | .90 | european union public licen | european union public licen[cs]e
eupl | .80 | eupl | eupl(?: v?1 [012])?
cecill-2.1 | .92 | cecill | (?:licen[cs]e )?cecill (?:licen[cs]e )?v?(?:ersion )?2 1
cecill-b | .90 | cecill b licen | cecill b licen[cs]e
cecill | .85 | cecill licen | cecill licen[cs]e
odbl-1.0 | .94 | open database licen | (?:open data commons )?open database licen[cs]e(?: v?1 0)?
odbl-1.0 | .85 | odbl | odbl(?: v?1 0)?
odc-by-1.0 | .93 | open data commons attribution licen | open data commons attribution licen[cs]e(?: v?1 0)?
pddl-1.0 | .93 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e(?: v?1 0)?
cc0-1.0 | .96 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | .92 | commons zero | creative commons zero(?: v?1 0)?
cc0-1.0 | .92 | publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-by-nc-nd-4.0 | .97 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-sa-4.0 | .97 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-4.0 | .97 | cc by nc | cc by nc 4 0
cc-by-nd-4.0 | .97 | cc by nd | cc by nd 4 0
cc-by-sa-4.0 | .97 | cc by sa | cc by sa 4 0
cc-by-nc-nd-3.0 | .97 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-sa-3.0 | .97 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-3.0 | .97 | cc by nc | cc by nc 3 0
cc-by-nd-3.0 | .97 | cc by nd | cc by nd 3 0
cc-by-sa-3.0 | .97 | cc by sa | cc by sa 3 0
cc-by-4.0 | .97 | cc by | cc by 4 0
cc-by-3.0 | .97 | cc by | cc by 3 0
cc-by-2.5 | .97 | cc by | cc by 2 5
cc-by-2.0 | .97 | cc by | cc by 2 0
cc-by-nc-nd | .92 | cc by nc nd | cc by nc nd
cc-by-nc-sa | .92 | cc by nc sa | cc by nc sa
cc-by-nc | .92 | cc by nc | cc by nc
cc-by-nd | .92 | cc by nd | cc by nd
cc-by-sa | .92 | cc by sa | cc by sa
cc-by-nc-nd | .94 | commons attribution noncommercial | creative commons attribution noncommercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international)?
cc-by-nc-sa | .94 | commons attribution noncommercial | creative commons attribution noncommercial share ?alike(?: [1-4] [05])?(?: international)?
cc-by-nc | .93 | commons attribution noncommercial | creative commons attribution noncommercial(?: [1-4] [05])?(?: international)?
cc-by-nc-sa | .94 | commons attribution non commercial | creative commons attribution non commercial share ?alike(?: [1-4] [05])?(?: international)?
cc-by-nc | .93 | commons attribution non commercial | creative commons attribution non commercial(?: [1-4] [05])?(?: international)?
cc-by-nd | .93 | commons attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international)?
cc-by-sa | .93 | commons attribution share | creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?
cc-by | .90 | commons attribution | creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc-nd | .94 | org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | .94 | org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | .93 | org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | .93 | org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | .93 | org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | .92 | org licenses by | creativecommons org licenses by(?: [1-4] [05])?
unlicense | .95 | unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | .88 | unlicense | (?:the )?unlicense
wtfpl | .92 | do what the fuck you want to public licen | do what the fuck you want to public licen[cs]e
wtfpl | .85 | wtfpl | wtfpl
beerware | .85 | beer ware licen | beer ware licen[cs]e
json | .80 | json licen | json licen[cs]e
fair | .75 | fair licen | fair licen[cs]e
public-domain | .75 | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
proprietary | .60 | all rights reserved | copyright (?:c )?(?:[^ ]+ ){0,8}all rights reserved
proprietary | .55 | licen | (?:proprietary|commercial) licen[cs]e
gpl | .60 | gnu general public licence | gnu general public licence
apache | .60 | apache licence | apache licence
mit | .60 | mit licence | mit licence
no-warranty | .40 | without warranty of any kind | provided as is without warranty of any kind
"""


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    weight: float
    keyword: str
    expression: str
    base: bool


def rules() -> list[Rule]:
    """All rules by rank; the phrases that are always counted come last and are never suppressed."""
    found = []
    for line in RULES.strip().splitlines():
        label, weight, keyword, expression = (part.strip() for part in line.split(" | "))
        found.append((label, float(weight), keyword, expression, False))
    found += [(label, 0.7, phrase, phrase, True) for phrase, label in BASE.items()]
    return [Rule(rank, *fields) for rank, fields in enumerate(found)]
