"""License scans by ordered signature rules.

A rule is a word pattern with a label, a priority and a keyword that has to be in the text before the pattern is tried. The rules are
written by hand, in order. Where detections overlap, the one of higher priority stands, and one that lies
inside a longer detection of at least its priority is suppressed; the base phrases of the contract are counted before that and their
labels always stay.

Scale: one map over the documents. The compiled rules are a constant; nothing is shuffled or gathered.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels. Fixed values.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The signatures, one a line: label, priority, weight, keyword, pattern over lower-case words. Fixed values, written by hand. V in a
#: label stands for the version that the pattern's group v matched.
SIGNATURES = r"""
# notices that say under what a work is licensed; V stands for a version
mit ; 45 ; 1.0 ; mit ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
mit ; 42 ; 1.0 ; expat ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?expat(?: licen[sc]e)?
mit ; 42 ; 1.0 ; x11 ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?x11(?: licen[sc]e)?
mit ; 35 ; 0.95 ; mit ; under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e
mit ; 30 ; 0.9 ; mit ; mit (?:style |x11 )?licen[sc]e
mit ; 30 ; 0.9 ; expat ; expat licen[sc]e
mit ; 25 ; 0.8 ; mit ; licen[sc]e mit
mit ; 48 ; 1.0 ; granted ; permission is hereby granted free of charge to any person obtaining a copy
mit ; 46 ; 0.9 ; sublicense ; to use copy modify merge publish distribute sublicense and or sell copies
mit-0 ; 49 ; 1.0 ; attribution ; mit no attribution(?: licen[sc]e)?
apache-V ; 45 ; 1.0 ; apache ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)
apache ; 40 ; 1.0 ; apache ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?
apache-V ; 34 ; 0.95 ; apache ; apache(?: software)?(?: public)? licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)
apache-V ; 33 ; 0.85 ; apache ; apache(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)(?: licen[sc]e)?
apache ; 30 ; 0.9 ; apache ; apache(?: software)? licen[sc]e
apache-2 ; 47 ; 1.0 ; apache ; www apache org licenses license 2 0
apache-2 ; 46 ; 0.9 ; compliance ; you may not use this file except in compliance with the licen[sc]e
gpl-V ; 45 ; 1.0 ; general ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1|2 0|2|3 0|3)
gpl ; 40 ; 1.0 ; general ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
gpl-V ; 45 ; 1.0 ; gpl ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?: version| ver| v)? ?v?(?P<v>1 0|1|2 0|2|3 0|3)
gpl ; 40 ; 1.0 ; gpl ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl-V ; 36 ; 0.95 ; general ; (?:gnu )?general public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1|2 0|2|3 0|3)
gpl ; 30 ; 0.9 ; general ; gnu general public licen[sc]e
gpl-V ; 33 ; 0.85 ; gpl ; (?:gnu )?gpl(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1|2 0|2|3 0|3)
gpl-V ; 33 ; 0.85 ; gplv3 ; gplv(?P<v>3)
gpl-V ; 33 ; 0.85 ; gplv2 ; gplv(?P<v>2)
gpl ; 28 ; 0.8 ; gpl ; (?:gnu gpl|gpl licen[sc]e)
gpl ; 47 ; 1.0 ; redistribute ; this program is free software you can redistribute it and or modify it
gpl ; 32 ; 0.8 ; copyleft ; (?:strong )?copyleft licen[sc]e
lgpl-V ; 46 ; 1.0 ; lesser ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e(?: version| ver| v)? v?(?P<v>2 1|2 0|2|3 0|3)
lgpl ; 43 ; 1.0 ; lesser ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e
lgpl-V ; 38 ; 0.95 ; lesser ; (?:gnu )?lesser general public licen[sc]e(?: version| ver| v)? v?(?P<v>2 1|2 0|2|3 0|3)
lgpl ; 37 ; 0.9 ; lesser ; (?:gnu )?lesser general public licen[sc]e
lgpl-V ; 38 ; 0.95 ; library ; gnu library general public licen[sc]e(?: version| ver| v)? v?(?P<v>2 1|2 0|2)
lgpl ; 37 ; 0.9 ; library ; gnu library general public licen[sc]e
lgpl-V ; 45 ; 1.0 ; lgpl ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?: version| ver| v)? v?(?P<v>2 1|2 0|2|3 0|3)
lgpl-V ; 33 ; 0.85 ; lgpl ; (?:gnu )?lgpl(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 1|2 0|2|3 0|3)
lgpl ; 28 ; 0.8 ; lgpl ; (?:gnu lgpl|lgpl licen[sc]e|under (?:the )?lgpl)
lgpl ; 47 ; 1.0 ; library ; this library is free software you can redistribute it and or modify it
agpl-V ; 46 ; 1.0 ; affero ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1|3 0|3)
agpl-V ; 38 ; 0.95 ; affero ; (?:gnu )?affero general public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1|3 0|3)
agpl ; 37 ; 0.9 ; affero ; (?:gnu )?affero general public licen[sc]e
agpl-V ; 45 ; 1.0 ; agpl ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?agpl(?: version| ver| v)? v?(?P<v>1 0|1|3 0|3)
agpl-V ; 33 ; 0.85 ; agpl ; (?:gnu )?agpl(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1|3 0|3)
agpl ; 28 ; 0.8 ; agpl ; (?:gnu agpl|agpl licen[sc]e|under (?:the )?agpl)
gfdl-V ; 38 ; 0.95 ; documentation ; (?:gnu )?free documentation licen[sc]e(?: version| ver| v)? v?(?P<v>1 1|1 2|1 3)
gfdl ; 37 ; 0.9 ; documentation ; gnu free documentation licen[sc]e
gfdl-V ; 33 ; 0.85 ; gfdl ; (?:gnu )?gfdl(?: version| ver| v)? v?(?P<v>1 1|1 2|1 3)
gfdl ; 28 ; 0.8 ; gfdl ; (?:gnu gfdl|gfdl licen[sc]e|under (?:the )?gfdl)
mpl-V ; 45 ; 1.0 ; mozilla ; (?:subject to the terms of|under) (?:the )?mozilla public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)
mpl-V ; 36 ; 0.95 ; mozilla ; mozilla public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)
mpl ; 30 ; 0.9 ; mozilla ; mozilla public licen[sc]e
mpl-V ; 33 ; 0.85 ; mpl ; mpl(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2)
mpl ; 28 ; 0.8 ; mpl ; (?:mpl licen[sc]e|under (?:the )?mpl)
epl-V ; 36 ; 0.95 ; eclipse ; eclipse public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1|2 0|2)
epl ; 30 ; 0.9 ; eclipse ; eclipse public licen[sc]e
edl-V ; 36 ; 0.95 ; eclipse ; eclipse distribution licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1)
epl-V ; 33 ; 0.85 ; epl ; epl(?: version| ver| v)? v?(?P<v>1 0|1|2 0|2)
cddl-V ; 36 ; 0.95 ; development ; common development and distribution licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1)
cddl ; 30 ; 0.9 ; development ; common development and distribution licen[sc]e
cddl-V ; 33 ; 0.85 ; cddl ; cddl(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1 1)
cddl ; 28 ; 0.8 ; cddl ; (?:cddl licen[sc]e|under (?:the )?cddl)
cpl-V ; 36 ; 0.95 ; common ; common public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0)
ipl-V ; 36 ; 0.95 ; ibm ; ibm public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0)
bsd-2-clause ; 44 ; 1.0 ; bsd ; (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?
bsd-2-clause ; 44 ; 1.0 ; simplified ; simplified bsd licen[sc]e
bsd-2-clause ; 44 ; 1.0 ; freebsd ; freebsd licen[sc]e
bsd-3-clause ; 44 ; 1.0 ; bsd ; (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?
bsd-3-clause ; 44 ; 1.0 ; bsd ; (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause ; 44 ; 1.0 ; bsd ; (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[sc]e)?
0bsd ; 46 ; 1.0 ; bsd ; (?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[sc]e)?
0bsd ; 44 ; 1.0 ; 0bsd ; 0bsd(?: licen[sc]e)?
bsd ; 40 ; 1.0 ; bsd ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?
bsd ; 30 ; 0.9 ; bsd ; bsd(?: style)? licen[sc]e
bsd ; 30 ; 0.9 ; berkeley ; berkeley software distribution licen[sc]e
bsd ; 47 ; 1.0 ; redistribution ; redistribution and use in source and binary forms with or without modification
bsd-3-clause ; 46 ; 0.95 ; endorse ; may be used to endorse or promote products derived from this software
bsd-4-clause ; 46 ; 0.95 ; advertising ; all advertising materials mentioning features or use of this software
isc ; 40 ; 1.0 ; isc ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[sc]e)?
isc ; 30 ; 0.9 ; isc ; isc licen[sc]e
isc ; 30 ; 0.9 ; internet ; internet systems consortium licen[sc]e
isc ; 47 ; 1.0 ; permission ; permission to use copy modify and or distribute this software for any purpose
zlib ; 38 ; 0.95 ; zlib ; zlib libpng licen[sc]e
zlib ; 30 ; 0.9 ; zlib ; zlib licen[sc]e
zlib ; 46 ; 1.0 ; held ; in no event will the authors be held liable for any damages arising from the use of this software
libpng ; 30 ; 0.9 ; libpng ; libpng licen[sc]e(?: version 2)?
artistic-V ; 36 ; 0.95 ; artistic ; artistic licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|2 0)
artistic ; 30 ; 0.9 ; artistic ; (?:perl )?artistic licen[sc]e
perl ; 45 ; 0.95 ; perl ; under the same terms as perl(?: itself)?
boost-V ; 38 ; 0.95 ; boost ; boost software licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1)
boost ; 30 ; 0.9 ; boost ; boost(?: software)? licen[sc]e
eupl-V ; 36 ; 0.95 ; european ; european union public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1|1 2)
eupl ; 30 ; 0.9 ; european ; european union public licen[sc]e
eupl-V ; 33 ; 0.85 ; eupl ; eupl(?: version| ver| v)? v?(?P<v>1 0|1 1|1 2)
osl-V ; 36 ; 0.95 ; open ; open software licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|2 0|2 1|3 0)
afl-V ; 36 ; 0.95 ; academic ; academic free licen[sc]e(?: version| ver| v)? v?(?P<v>1 1|1 2|2 0|2 1|3 0)
afl ; 30 ; 0.9 ; academic ; academic free licen[sc]e
cecill-V ; 36 ; 0.95 ; cecill ; cecill(?: b| c)?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|1 1|2 0|2 1)
cecill ; 30 ; 0.9 ; cecill ; cecill(?: b| c)? licen[sc]e
ms-pl ; 38 ; 0.95 ; microsoft ; microsoft public licen[sc]e
ms-rl ; 38 ; 0.95 ; microsoft ; microsoft reciprocal licen[sc]e
ms-pl ; 30 ; 0.8 ; pl ; ms pl
python-V ; 38 ; 0.95 ; python ; python software foundation licen[sc]e(?: version| ver| v)? v?(?P<v>2 0|2)
python ; 30 ; 0.9 ; python ; python(?: software foundation)? licen[sc]e
python ; 28 ; 0.8 ; psf ; psf licen[sc]e
php-V ; 36 ; 0.95 ; php ; php licen[sc]e(?: version| ver| v)? v?(?P<v>3 0|3 01)
php ; 30 ; 0.9 ; php ; php licen[sc]e
ruby ; 30 ; 0.9 ; ruby ; (?:ruby licen[sc]e|under the same terms as ruby)
openssl ; 30 ; 0.9 ; openssl ; openssl licen[sc]e
curl ; 30 ; 0.9 ; curl ; curl licen[sc]e
ncsa ; 36 ; 0.9 ; ncsa ; (?:university of illinois )?ncsa open source licen[sc]e
w3c ; 36 ; 0.9 ; w3c ; w3c software(?: notice and)? licen[sc]e
unicode ; 36 ; 0.9 ; unicode ; unicode(?: data files and software)? licen[sc]e
postgresql ; 30 ; 0.9 ; postgresql ; postgresql licen[sc]e
vim ; 30 ; 0.9 ; vim ; vim licen[sc]e
latex-V ; 38 ; 0.95 ; latex ; latex project public licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1|1 2|1 3)
latex ; 30 ; 0.9 ; latex ; latex project public licen[sc]e
upl-V ; 36 ; 0.95 ; universal ; universal permissive licen[sc]e(?: version| ver| v)? v?(?P<v>1 0)
blueoak-V ; 36 ; 0.95 ; oak ; blue oak model licen[sc]e(?: version| ver| v)? v?(?P<v>1 0)
unlicense ; 45 ; 1.0 ; unlicense ; (?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?unlicense
unlicense ; 30 ; 0.9 ; unlicense ; (?:the )?unlicense
unlicense ; 47 ; 1.0 ; unencumbered ; this is free and unencumbered software released into the public domain
wtfpl ; 38 ; 0.95 ; wtfpl ; wtfpl(?: version 2)?
wtfpl ; 38 ; 0.95 ; want ; do what the fuck you want to public licen[sc]e
beerware ; 38 ; 0.9 ; beer ; beer ware licen[sc]e
json ; 38 ; 0.9 ; evil ; the software shall be used for good not evil
sspl-V ; 38 ; 0.95 ; server ; server side public licen[sc]e(?: version| ver| v)? v?(?P<v>1)
sspl ; 36 ; 0.9 ; server ; server side public licen[sc]e
busl-V ; 38 ; 0.95 ; business ; business source licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1)
busl ; 36 ; 0.9 ; business ; business source licen[sc]e
elastic-V ; 38 ; 0.95 ; elastic ; elastic licen[sc]e(?: version| ver| v)? v?(?P<v>2 0|2)
commons-clause ; 38 ; 0.95 ; commons ; commons clause(?: licen[sc]e)?
polyform ; 38 ; 0.95 ; polyform ; polyform (?:noncommercial|shield|strict|small business)(?: licen[sc]e)?
openrail ; 38 ; 0.95 ; openrail ; (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[sc]e)?
rail ; 36 ; 0.9 ; responsible ; responsible ai licen[sc]e
llama ; 38 ; 0.95 ; llama ; llama(?: 2| 3)? community licen[sc]e(?: agreement)?
ogl-V ; 38 ; 0.95 ; government ; open government licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|2 0|3 0)
ogl ; 36 ; 0.9 ; government ; open government licen[sc]e
odbl-V ; 36 ; 0.95 ; database ; open database licen[sc]e(?: version| ver| v)? v?(?P<v>1 0)
odbl ; 30 ; 0.9 ; database ; open database licen[sc]e
odbl ; 30 ; 0.85 ; odbl ; odbl(?: version| ver| v)?(?: v?1 0)?
odc-by ; 36 ; 0.95 ; commons ; open data commons attribution licen[sc]e
pddl ; 36 ; 0.95 ; commons ; open data commons public domain dedication(?: and licen[sc]e)?
cdla-permissive-V ; 38 ; 0.95 ; community ; community data licen[sc]e agreement permissive(?: version| ver| v)? v?(?P<v>1 0|2 0)
cdla-sharing-V ; 38 ; 0.95 ; community ; community data licen[sc]e agreement sharing(?: version| ver| v)? v?(?P<v>1 0)
ofl-V ; 36 ; 0.95 ; font ; (?:sil )?open font licen[sc]e(?: version| ver| v)? v?(?P<v>1 0|1 1)
ofl ; 30 ; 0.9 ; font ; (?:sil )?open font licen[sc]e
cc0-V ; 36 ; 0.95 ; cc0 ; cc0(?: version| ver| v)? v?(?P<v>1 0)(?: universal)?
cc0 ; 30 ; 0.9 ; cc0 ; cc0(?: licen[sc]e)?
cc0 ; 36 ; 0.95 ; zero ; (?:creative commons|cc) zero(?: licen[sc]e)?
cc-by-nc-nd-V ; 44 ; 1.0 ; nd ; cc by nc nd(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc-nd ; 43 ; 0.9 ; nd ; cc by nc nd
cc-by-nc-sa-V ; 44 ; 1.0 ; sa ; cc by nc sa(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc-sa ; 43 ; 0.9 ; sa ; cc by nc sa
cc-by-nc-V ; 42 ; 1.0 ; nc ; cc by nc(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc ; 41 ; 0.9 ; nc ; cc by nc
cc-by-nd-V ; 42 ; 1.0 ; nd ; cc by nd(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nd ; 41 ; 0.9 ; nd ; cc by nd
cc-by-sa-V ; 42 ; 1.0 ; sa ; cc by sa(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-sa ; 41 ; 0.9 ; sa ; cc by sa
cc-by-V ; 40 ; 1.0 ; cc ; cc by(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|2 0|2 5|3 0|4 0)
cc-by ; 34 ; 0.8 ; cc ; cc by licen[sc]e
cc-by-nc-nd-V ; 46 ; 1.0 ; creative ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: (?:international|unported|generic))?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc-nd ; 45 ; 0.95 ; creative ; creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa-V ; 46 ; 1.0 ; creative ; creative commons attribution non ?commercial share ?alike(?: (?:international|unported|generic))?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc-sa ; 45 ; 0.95 ; creative ; creative commons attribution non ?commercial share ?alike
cc-by-nc-V ; 44 ; 1.0 ; creative ; creative commons attribution non ?commercial(?: (?:international|unported|generic))?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nc ; 43 ; 0.95 ; creative ; creative commons attribution non ?commercial
cc-by-nd-V ; 44 ; 1.0 ; creative ; creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>2 0|2 5|3 0|4 0)
cc-by-nd ; 43 ; 0.95 ; creative ; creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa-V ; 44 ; 1.0 ; creative ; creative commons attribution share ?alike(?: (?:international|unported|generic))?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|2 0|2 5|3 0|4 0)
cc-by-sa ; 43 ; 0.95 ; creative ; creative commons attribution share ?alike
cc-by-V ; 42 ; 1.0 ; creative ; creative commons attribution(?: (?:international|unported|generic))?(?: licen[sc]e)?(?: version| ver| v)? v?(?P<v>1 0|2 0|2 5|3 0|4 0)
cc-by ; 38 ; 0.9 ; creative ; creative commons attribution(?: licen[sc]e)?
cc ; 20 ; 0.6 ; creative ; creative commons(?: licen[sc]e)?
# tags of files
spdx ; 15 ; 0.6 ; spdx ; spdx licen[sc]e identifier
mit ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier mit
apache-V ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier apache (?P<v>1 0|1 1|2 0)
gpl-V ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier gpl (?P<v>1 0|2 0|3 0)(?: only| or later)?
lgpl-V ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier lgpl (?P<v>2 0|2 1|3 0)(?: only| or later)?
agpl-V ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier agpl (?P<v>1 0|3 0)(?: only| or later)?
mpl-V ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier mpl (?P<v>1 0|1 1|2 0)
bsd-2-clause ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier bsd 2 clause
bsd-3-clause ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier bsd 3 clause
isc ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier isc
cc0 ; 50 ; 1.0 ; spdx ; spdx licen[sc]e identifier cc0 1 0
# what is reserved, given up or forbidden
public-domain ; 40 ; 0.9 ; domain ; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain ; 35 ; 0.8 ; domain ; public domain dedication
public-domain ; 10 ; 0.5 ; domain ; public domain
proprietary ; 30 ; 0.8 ; proprietary ; (?:confidential and proprietary|proprietary and confidential)
proprietary ; 28 ; 0.8 ; proprietary ; proprietary (?:software )?licen[sc]e
proprietary ; 28 ; 0.7 ; agreement ; end user licen[sc]e agreement
proprietary ; 20 ; 0.6 ; reserved ; all rights reserved
proprietary ; 24 ; 0.7 ; prohibited ; unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|work|document))?(?: via any medium)? is (?:strictly )?prohibited
noncommercial ; 24 ; 0.7 ; commercial ; (?:for )?non commercial use only
research-only ; 24 ; 0.7 ; research ; for research (?:purposes|use) only
copyright ; 5 ; 0.4 ; copyright ; copyright (?:c )?(?:19|20)[0-9][0-9]
"""


def _rules() -> list[tuple]:
    """(label, compiled pattern, keyword, priority, weight), the highest priority first, in the order of SIGNATURES within one."""
    made = []
    for line in SIGNATURES.splitlines():
        if line and not line.startswith("#"):
            label, priority, weight, keyword, pattern = line.split(" ; ")
            made.append((label, re.compile(rf"(?<! ) {pattern}(?= )".encode()), keyword.encode(), int(priority), float(weight)))
    return sorted(made, key=lambda r: -r[3])


def _label(rule: str, m: re.Match) -> str:
    """A rule's label; versions as numbers with points, of which a last zero goes."""
    return rule if not rule.endswith("-V") else rule[:-1] + m["v"].decode().removesuffix(" 0").replace(" ", ".")


def _fold() -> bytes:
    """Byte table: A-Z to lower case, other ASCII but digits and letters to a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def suppress(found: list[tuple]) -> list[tuple]:
    """Keep, of (start, end, priority, weight, label), those that no kept one of higher or equal priority overlaps or contains."""
    kept: list[tuple] = []  # sorted; none overlaps another, so only neighbours can overlap a new one
    for x in sorted(found, key=lambda r: (-r[2], r[0] - r[1], r[0], r[4])):
        at = bisect.bisect(kept, x[:2])
        if not any(x[0] < y[1] and y[0] < x[1] for y in kept[max(0, at - 1) : at + 1]):
            kept.insert(at, x)
    return kept


def gate(rules: list[tuple]) -> re.Pattern:
    """One scan for any keyword as a word; most documents end there. The base phrases have keywords of their own."""
    keywords = {r[2] for r in rules} | {max(p.split(), key=len).encode() for p in BASE_PHRASES} | {b"mit", b"cc"}
    return re.compile(b" (?:" + b"|".join(sorted(re.escape(k) for k in keywords)) + b") ")


def scan(data: bytes, rules: list[tuple], fold: bytes, gates: re.Pattern) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = data.translate(fold).split()
    line = b" " + b" ".join(words) + b" "
    if not gates.search(line):
        return (len(words), 0, None, None, "", "", 0.0)
    places, base = [], set()
    for phrase, label in BASE_PHRASES.items():
        target, at, before, word = f" {phrase} ".encode(), -1, 0, 0
        while (at := line.find(target, at + 1)) >= 0:
            word, before = word + line.count(b" ", before, at), at
            places.append(word)
            base.add(label)
    present = set(words)
    found = []
    for label, pattern, keyword, priority, weight in rules:
        if keyword in present:
            found += [(m.start(), m.end(), priority, weight, _label(label, m)) for m in pattern.finditer(line)]
    kept = suppress(found)
    labels = base | {x[4] for x in kept}
    score = max([*(x[3] for x in kept), *([0.9] if base else []), 0.0])
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        float(score),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, base phrases, labels and a score.

    Null and empty texts have no words, no labels and score zero. Labels are distinct, sorted and joined by commas. The score is the
    weight of the strongest standing detection. A text is taken whole, whatever its length; repeated rows each get their row.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, fold = _rules(), _fold()
        gates = gate(rules)
        for batch in batches:
            for part in common.parts(batch):
                rows = [scan(x, rules, fold, gates) for x in common.utf8(part.column(1))]
                columns = list(zip(*rows, strict=True))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, schema)
