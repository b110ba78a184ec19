"""Signature rules of licenses, written by hand: label | keyword | pattern, the more special ones of a family first.

In a pattern a blank stands for any short gap, ` ?` for a blank or hyphen that may be missing, {v} for the word `version` in its
forms, {l} for both spellings of license, {later} for `or (at your option) any later`, and a final $ for the end of a word or
number. Patterns are matched on text in lower case (A-Z).
"""

RULES = """
agpl-3.0-or-later | affero | affero general public {l}(?: as published by the free software foundation)?,? {v}3(?:\\.0)?{later}
agpl-3.0 | affero | affero general public {l}(?: as published by the free software foundation)?,? {v}3
agpl-1.0 | affero | affero general public {l},? {v}1
agpl-3.0-or-later | agpl | agpl ?{v}3(?:\\.0)?(?:\\+|{later}$)
agpl-3.0-only | agpl | agpl ?{v}3(?:\\.0)? only$
agpl-3.0 | agpl | agpl ?{v}3(?:\\.0)?$
agpl-3.0 | gnu.org/licenses/agpl | gnu\\.org/licenses/agpl(?:-3\\.0)?
agpl | affero | affero general public {l}
agpl | agpl | agpl$
lgpl-2.1-or-later | lesser | lesser general public {l},? {v}2\\.1{later}
lgpl-2.1 | lesser | lesser general public {l},? {v}2\\.1
lgpl-3.0-or-later | lesser | lesser general public {l},? {v}3(?:\\.0)?{later}
lgpl-3.0 | lesser | lesser general public {l},? {v}3
lgpl-2.1-or-later | lgpl | lgpl ?{v}2\\.1(?:\\+|{later}$)
lgpl-2.1-only | lgpl | lgpl ?{v}2\\.1 only$
lgpl-2.1 | lgpl | lgpl ?{v}2\\.1$
lgpl-2.0-or-later | lgpl | lgpl ?{v}2(?:\\.0)?(?:\\+|{later}$)
lgpl-2.0-only | lgpl | lgpl ?{v}2(?:\\.0)? only$
lgpl-2.0 | lgpl | lgpl ?{v}2(?:\\.0)?$
lgpl-3.0-or-later | lgpl | lgpl ?{v}3(?:\\.0)?(?:\\+|{later}$)
lgpl-3.0-only | lgpl | lgpl ?{v}3(?:\\.0)? only$
lgpl-3.0 | lgpl | lgpl ?{v}3(?:\\.0)?$
lgpl-2.1 | gnu.org/licenses | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-3.0 | gnu.org/licenses | gnu\\.org/licenses/lgpl-3\\.0
lgpl | lesser | lesser general public {l}
lgpl-2.0-or-later | library general | library general public {l},? {v}2(?:\\.0)?{later}
lgpl-2.0 | library general | library general public {l},? {v}2
lgpl | library general | library general public {l}
lgpl | lgpl | lgpl$
gpl-2.0-with-classpath-exception | classpath | (?:general public {l}|gpl)[^.]{0,60}classpath exception
classpath-exception-2.0 | classpath | classpath exception
gcc-exception-3.1 | runtime library exception | gcc runtime library exception
bison-exception-2.2 | bison | special exception,? you may create a larger work that contains part or all of the bison parser
autoconf-exception | autoconf | autoconf (?:configure script )?exception
linux-syscall-note | syscall | linux syscall note
llvm-exception | llvm | llvm exceptions?
openssl-exception | openssl | (?:exception|permission)[^.]{0,60}link[^.]{0,60}openssl
font-exception | font exception | font exception
wxwindows | wxwindows | wxwindows library licen[sc]e
gpl-3.0-or-later | general public | general public {l},? {v}3(?:\\.0)?{later}
gpl-2.0-or-later | general public | general public {l},? {v}2(?:\\.0)?{later}
gpl-3.0 | general public | general public {l},? {v}3
gpl-2.0 | general public | general public {l},? {v}2
gpl-1.0 | general public | general public {l},? {v}1
gpl-3.0-or-later | gpl | gpl ?{v}3(?:\\.0)?(?:\\+|{later}$)
gpl-3.0-only | gpl | gpl ?{v}3(?:\\.0)? only$
gpl-3.0 | gpl | gpl ?{v}3(?:\\.0)?$
gpl-2.0-or-later | gpl | gpl ?{v}2(?:\\.0)?(?:\\+|{later}$)
gpl-2.0-only | gpl | gpl ?{v}2(?:\\.0)? only$
gpl-2.0 | gpl | gpl ?{v}2(?:\\.0)?$
gpl-1.0-or-later | gpl | gpl ?{v}1(?:\\.0)?(?:\\+|{later}$)
gpl-1.0 | gpl | gpl ?{v}1(?:\\.0)?$
gpl-3.0 | gnu.org/licenses | gnu\\.org/licenses/gpl-3\\.0
gpl-2.0 | gnu.org/licenses | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
gpl | general public | general public {l}
gpl | gnu.org/licenses | gnu\\.org/licenses/gpl
gpl | gpl | (?:gnu )?gpl licensed?$
gfdl-1.3 | free documentation | free documentation {l},? {v}1\\.3
gfdl-1.2 | free documentation | free documentation {l},? {v}1\\.2
gfdl-1.1 | free documentation | free documentation {l},? {v}1\\.1
gfdl-1.3 | gfdl | gfdl ?{v}1\\.3$
gfdl-1.2 | gfdl | gfdl ?{v}1\\.2$
gfdl | free documentation | free documentation {l}
gfdl | gnu.org/licenses | gnu\\.org/licenses/fdl
apache-2.0 | apache | apache(?: software)? {l},? {v}2(?:\\.0)?
apache-2.0 | apache | apache {v}2(?:\\.0)? {l}
apache-2.0 | apache | apache {v}2\\.0$
apache-2.0 | apache.org/licenses | apache\\.org/licenses/license-2\\.0
apache-2.0 | asl | asl ?{v}2(?:\\.0)?$
apache-1.1 | apache | apache(?: software)? {l},? {v}1\\.1
apache-1.1 | apache | apache {v}1\\.1 {l}
apache-1.0 | apache | apache(?: software)? {l},? {v}1\\.0
apache | apache | apache(?: software)? {l}
mit-0 | mit no attribution | mit no attribution
mit-0 | mit-0 | mit-0$
mit-advertising | enlightenment | enlightenment {l}
mit-cmu | carnegie mellon | cmu {l}|carnegie mellon[^.]{0,40}permission to use, copy, modify
mit-feh | feh {l} | feh licen[sc]e
mit-modern-variant | modern variant | mit {l} modern variant
mit | mit {l} | (?:the )?mit {l}
mit | mit licensed | mit licensed$
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
mit | opensource.org/licenses | opensource\\.org/licenses?/mit
mit | licensed under | licensed under (?:the )?(?:terms of (?:the )?)?mit$
mit | released under | released under (?:the )?(?:terms of (?:the )?)?mit$
mit | distributed under | distributed under (?:the )?(?:terms of (?:the )?)?mit$
mit | choosealicense | choosealicense\\.com/licenses/mit
x11 | x11 {l} | x11 {l}
x11 | x consortium | name of the x consortium shall not be used
expat | expat | expat {l}
bsd-4-clause | bsd | (?:4|four) clause bsd(?: {l})?
bsd-3-clause-clear | bsd | (?:bsd 3 clause clear|clear bsd) {l}
bsd-3-clause | bsd | (?:3|three) clause bsd(?: {l})?
bsd-3-clause | bsd | bsd (?:3|three) clause
bsd-3-clause | bsd | new bsd {l}
bsd-3-clause | bsd | modified bsd {l}
bsd-3-clause | bsd | revised bsd {l}
bsd-2-clause-patent | bsd | bsd (?:2 clause )?plus patent {l}
bsd-2-clause | bsd | (?:2|two) clause bsd(?: {l})?
bsd-2-clause | bsd | bsd (?:2|two) clause
bsd-2-clause | bsd | simplified bsd {l}
bsd-2-clause | freebsd | freebsd {l}
bsd-4-clause | bsd | bsd (?:4|four) clause
bsd-4-clause | bsd | original bsd {l}
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
bsd-3-clause-lbnl | lawrence berkeley | lawrence berkeley[^.]{0,60}bsd {l}
bsd-1-clause | bsd | (?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: {l})?
0bsd | bsd | (?:zero clause bsd|bsd zero clause)
0bsd | 0bsd | 0bsd$
bsd-3-clause | endorse or promote | names? of (?:its|the|any) (?:contributors|copyright holders?)[^.]{0,40}(?:may|be used to) be used to endorse or promote products
bsd | bsd | bsd {l}
bsd | bsd | bsd licensed$
bsd | bsd | bsd style {l}
bsd | opensource.org/licenses | opensource\\.org/licenses?/bsd
bsd | redistribution and use | redistribution and use in source and binary forms
isc | isc {l} | isc {l}
isc | permission to use, copy | permission to use, copy, modify, and/or distribute this software
isc | internet systems consortium | internet systems consortium[^.]{0,40}{l}
zlib-acknowledgement | zlib | zlib {l} with acknowledgement
zlib | zlib | zlib(?: libpng)? {l}
zlib | altered source versions | altered source versions must be plainly marked as such
libpng-2.0 | libpng | libpng {l},? {v}2
libpng | libpng | libpng {l}
bsl-1.0 | boost | boost software {l},? {v}1
bsl-1.0 | boost | boost software {l}
bsl-1.0 | boost.org | boost\\.org/license_1_0
bsl-1.0 | bsl-1.0 | bsl-1\\.0$
mpl-2.0-no-copyleft-exception | incompatible with secondary | incompatible with secondary licenses
mpl-2.0 | mozilla | mozilla public {l},? {v}2
mpl-1.1 | mozilla | mozilla public {l},? {v}1\\.1
mpl-1.0 | mozilla | mozilla public {l},? {v}1\\.0
mpl-2.0 | mpl | mpl ?{v}2(?:\\.0)?$
mpl-1.1 | mpl | mpl ?{v}1\\.1$
mpl-2.0 | mozilla.org/mpl | mozilla\\.org/mpl/2\\.0
mpl-1.1 | mozilla.org/mpl | mozilla\\.org/mpl/1\\.1
mpl | mozilla | mozilla public {l}
epl-2.0 | eclipse | eclipse public {l},? {v}2
epl-1.0 | eclipse | eclipse public {l},? {v}1
epl-2.0 | epl | epl ?{v}2(?:\\.0)?$
epl-1.0 | epl | epl ?{v}1(?:\\.0)?$
epl-1.0 | eclipse.org/legal | eclipse\\.org/legal/epl-v10
epl-2.0 | eclipse.org/legal | eclipse\\.org/legal/epl-(?:2\\.0|v20)
epl | eclipse | eclipse public {l}
edl-1.0 | eclipse | eclipse distribution {l}
cddl-1.1 | common development | common development and distribution {l},? (?:\\(cddl\\) )?{v}1\\.1
cddl-1.0 | common development | common development and distribution {l}
cddl-1.1 | cddl | cddl ?{v}1\\.1$
cddl-1.0 | cddl | cddl ?{v}1(?:\\.0)?$
cpal-1.0 | common public attribution | common public attribution {l}
cpl-1.0 | common public | common public {l}
eupl-1.2 | european union public | european union public {l},? {v}1\\.2
eupl-1.1 | european union public | european union public {l},? {v}1\\.1
eupl-1.2 | eupl | eupl ?{v}1\\.2$
eupl | european union public | european union public {l}
osl-3.0 | open software {l} | open software {l},? {v}3
osl-2.1 | open software {l} | open software {l},? {v}2\\.1
nposl-3.0 | open software {l} | non profit open software {l}
osl | open software {l} | open software {l}
afl-3.0 | academic free | academic free {l},? {v}3
afl-2.1 | academic free | academic free {l},? {v}2\\.1
afl | academic free | academic free {l}
artistic-2.0 | artistic | artistic {l},? {v}2
artistic-1.0 | artistic | artistic {l},? {v}1
artistic-1.0-cl8 | artistic | clarified artistic {l}
artistic | artistic | artistic {l}
perl | same terms as perl | under the same terms as perl(?: itself)?
psf-2.0 | python software | python software foundation {l}
psf-2.0 | psf {l} | psf {l}
cnri-python | cnri | cnri (?:open source )?(?:python )?{l}
python-2.0 | python {l} | python {l},? {v}2
php-3.01 | php {l} | php {l},? {v}3\\.01
php-3.0 | php {l} | php {l}
zend-2.0 | zend engine | zend engine {l}
ruby | ruby {l} | ruby(?:'s)? {l}
unlicense | unlicense | the unlicense
unlicense | unlicense.org | unlicense\\.org
unlicense | unencumbered | this is free and unencumbered software
wtfpl | want to public | do what the f\\w{1,6} you want to public {l}
wtfpl | wtfpl | wtfpl
cc0-1.0 | cc0 | cc0(?: {v}1\\.0)?(?: universal)?
cc0-1.0 | creativecommons.org/publicdomain | creativecommons\\.org/publicdomain/zero/1\\.0
cc-pdm-1.0 | creativecommons.org/publicdomain | creativecommons\\.org/publicdomain/mark/1\\.0
cc0-1.0 | no rights reserved | no rights reserved
public-domain | public domain | (?:dedicated to|placed in|released (?:in)?to|in) the public domain
cc-by-nc-nd-4.0 | cc by | cc by nc nd {v}4
cc-by-nc-sa-4.0 | cc by | cc by nc sa {v}4
cc-by-nc-4.0 | cc by | cc by nc {v}4
cc-by-nd-4.0 | cc by | cc by nd {v}4
cc-by-sa-4.0 | cc by | cc by sa {v}4
cc-by-4.0 | cc by | cc by {v}4
cc-by-nc-nd-3.0 | cc by | cc by nc nd {v}3
cc-by-nc-sa-3.0 | cc by | cc by nc sa {v}3
cc-by-nc-3.0 | cc by | cc by nc {v}3
cc-by-nd-3.0 | cc by | cc by nd {v}3
cc-by-sa-3.0 | cc by | cc by sa {v}3
cc-by-3.0 | cc by | cc by {v}3
cc-by-sa-2.5 | cc by | cc by sa {v}2\\.5
cc-by-2.5 | cc by | cc by {v}2\\.5
cc-by-2.0 | cc by | cc by {v}2\\.0
cc-by-nc-nd | cc by | cc by nc nd
cc-by-nc-sa | cc by | cc by nc sa
cc-by-nc | cc by | cc by nc
cc-by-nd | cc by | cc by nd
cc-by-sa | cc by | cc by sa
cc-by-nc-nd-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-nc-nd/4\\.0
cc-by-nc-sa-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-nc-sa/4\\.0
cc-by-nc-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-nc/4\\.0
cc-by-nd-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-nd/4\\.0
cc-by-sa-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-sa/4\\.0
cc-by-4.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by/4\\.0
cc-by-sa-3.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by-sa/3\\.0
cc-by-3.0 | creativecommons.org/licenses | creativecommons\\.org/licenses/by/3\\.0
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv\\w*(?: {v}4(?:\\.0)?)(?: international)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike {v}4(?:\\.0)?(?: international)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial {v}4(?:\\.0)?(?: international)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv\\w* {v}4(?:\\.0)?(?: international)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike {v}4(?:\\.0)?(?: international)?
cc-by-4.0 | creative commons | creative commons attribution(?: {l})? {v}4(?:\\.0)?(?: international)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike {v}3(?:\\.0)?(?: unported)?
cc-by-3.0 | creative commons | creative commons attribution(?: {l})? {v}3(?:\\.0)?(?: unported)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv\\w*
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | creative commons attribution non ?commercial
cc-by-nd | creative commons | creative commons attribution no ?deriv\\w*
cc-by-sa | creative commons | creative commons attribution share ?alike
cc-by | creative commons | creative commons attribution
creative-commons | creative commons | creative commons {l}
odbl-1.0 | open database | open database {l}
odc-by-1.0 | open data commons | open data commons attribution
pddl-1.0 | open data commons | open data commons public domain dedication
cdla-permissive-2.0 | community data | community data {l} agreement permissive,? {v}2
cdla-permissive-1.0 | community data | community data {l} agreement permissive
cdla-sharing-1.0 | community data | community data {l} agreement sharing
o-uda-1.0 | open use of data | open use of data agreement
etalab-2.0 | licence ouverte | licence ouverte
ogl-uk-3.0 | open government | open government {l},? {v}3
ogl-uk | open government | open government {l}
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland
d-fsl-1.0 | freie software | deutsche freie software lizenz
ofl-1.1 | open font | (?:sil )?open font {l}(?:,? {v}1\\.1)?
ofl-1.1 | scripts.sil.org | scripts\\.sil\\.org/ofl
lppl-1.3c | latex project | latex project public {l},? {v}1\\.3c
lppl | latex project | latex project public {l}
ms-pl | microsoft public | microsoft public {l}
ms-rl | microsoft reciprocal | microsoft reciprocal {l}
ms-lpl | microsoft limited public | microsoft limited public {l}
ncsa | university of illinois | university of illinois(?: ncsa)? open source {l}
postgresql | postgresql {l} | postgresql {l}
openssl | openssl {l} | openssl {l}
ssleay | ssleay | (?:original )?ssleay {l}
openldap | openldap | openldap public {l}
sleepycat | sleepycat | sleepycat {l}
vim | vim {l} | vim {l}
w3c | w3c | w3c software (?:notice and )?{l}
curl | curl {l} | curl {l}
ijg | independent jpeg | independent jpeg group(?:'s)? (?:software|{l})
ftl | freetype | freetype (?:project )?{l}
imagemagick | imagemagick {l} | imagemagick {l}
info-zip | info-zip | info-zip {l}
libtiff | libtiff {l} | libtiff {l}
net-snmp | net-snmp | net-snmp {l}
ntp | ntp {l} | ntp {l}
tcl | tcl | tcl(?: tk)? {l}
hpnd | historical permission | historical permission notice and disclaimer
sgi-b-2.0 | sgi free software | sgi free software {l} b
smlnj | standard ml | standard ml of new jersey {l}
xfree86-1.1 | xfree86 | xfree86 {l}
unicode-dfs-2016 | unicode {l} | unicode {l} agreement
unicode-3.0 | unicode {l} | unicode {l},? {v}3
zpl-2.1 | zope public | zope public {l},? {v}2\\.1
zpl | zope public | zope public {l}
qpl-1.0 | q public | q public {l}
ipl-1.0 | ibm public | ibm public {l}
lpl-1.02 | lucent public | lucent public {l}
apsl-2.0 | apple public | apple public source {l}
npl-1.1 | netscape public | netscape public {l}
spl-1.0 | sun public | sun public {l}
sissl | sun industry | sun industry standards source {l}
rpl-1.5 | reciprocal public | reciprocal public {l}
rscpl | ricoh source | ricoh source code public {l}
nokia | nokia open | nokia open source {l}
intel | intel open | intel open source {l}
nasa-1.3 | nasa open | nasa open source agreement
watcom-1.0 | watcom | sybase open watcom public {l}
vsl-1.0 | vovida | vovida software {l}
ecl-2.0 | educational community | educational community {l},? {v}2
ecl-1.0 | educational community | educational community {l}
apl-1.0 | adaptive public | adaptive public {l}
aladdin | aladdin | aladdin free public {l}
simpl-2.0 | simple public | simple public {l}
fair | fair {l} | fair {l}
bittorrent-1.1 | bittorrent | bittorrent open source {l}
cecill-2.1 | cecill | cecill {v}2\\.1
cecill-b | cecill | cecill b$
cecill-c | cecill | cecill c$
cecill | cecill | cecill(?: {l})?
upl-1.0 | universal permissive | universal permissive {l}
blueoak-1.0.0 | blue oak | blue oak model {l}
mulan-psl-2.0 | mulan | mulan permissive software {l},? {v}2
mulan-psl | mulan | mulan permissive software {l}
cal-1.0 | cryptographic autonomy | cryptographic autonomy {l}
cern-ohl-s-2.0 | cern open hardware | cern open hardware {l}[^.]{0,30}strongly reciprocal
cern-ohl | cern open hardware | cern open hardware {l}
tapr-ohl-1.0 | tapr | tapr open hardware {l}
solderpad | solderpad | solderpad hardware {l}
lal-1.3 | free art | free art {l}
busl-1.1 | business source | business source {l}
sspl-1.0 | server side public | server side public {l}
elastic-2.0 | elastic {l} | elastic {l}
confluent-community-1.0 | confluent community | confluent community {l}
commons-clause | commons clause | commons clause
polyform-noncommercial-1.0.0 | polyform | polyform noncommercial {l}
polyform | polyform | polyform (?:small business|shield|strict|perimeter) {l}
prosperity-3.0 | prosperity public | prosperity public {l}
parity-7.0 | parity public | parity public {l}
hippocratic-2.1 | hippocratic | hippocratic {l}
bigscience-openrail-m | openrail | bigscience openrail m
openrail | openrail | openrail(?: ?m| ?s)?$
llama-community | community {l} agreement | llama ?\\d(?:\\.\\d)? community {l} agreement
json | used for good | shall be used for good, not evil
beerware | beer | beer ?ware {l}
proprietary | proprietary | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this file
proprietary | trade secret | contains (?:confidential and )?trade secrets?
reserved | rights reserved | all rights reserved
copyright | copyright | copyright (?:\\(c\\)|©)? ?(?:19|20)\\d\\d
copyright | © | © ?(?:19|20)\\d\\d
"""

#: Further identifiers that a `SPDX-License-Identifier:` line may name, besides the labels above.
IDENTIFIERS = frozenset("""
aal afl-1.1 afl-1.2 afl-2.0 agpl-1.0-only artistic-1.0-perl catosl-1.1 cc-by-1.0 cua-opl-1.0 efl-1.0 efl-2.0 entessa eudatagrid
frameworx-1.0 gpl-1.0-only ipa jam liliq-p-1.1 liliq-r-1.1 lpl-1.0 miros motosoto multics naumen ngpl oclc-2.0 ogtsl oldap-2.8
oset-pl-2.1 osl-1.0 osl-2.0 rpl-1.1 rpsl-1.0 ucl-1.0 xnet zpl-2.0
""".split())
