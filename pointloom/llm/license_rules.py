"""The signature rules of the license scan, written out one by one.

A line of RULES in brackets names a root, a piece of text without which none of
the rules under it can match.  Every other line is one rule: priority, keyword,
label and expression.  The keyword is in every match, too, where a word begins.  A
blank in an expression or a keyword stands for one to eight characters that are no letters or digits, so
that a notice may wrap, be quoted, or sit behind comment marks; a match begins and
ends where a word does.  Texts are lower-cased before.
"""

from __future__ import annotations

from dataclasses import dataclass

#: What a blank of an expression stands for: ASCII that is neither letter nor digit.
BLANK = r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]{1,8})"

RULES = r"""
[licen]
96 | apache | apache-2.0 | licensed under the apache licen[cs]e version 2\.0
95 | apache | apache-2.0 | apache licen[cs]e version 2\.0 january 2004
94 | apache | apache-2.0 | (?:you may obtain a copy of the licen[cs]e at )?(?:https? )?www apache org licenses license 2\.0
92 | apache | apache-2.0 | (?:the )?apache(?: software)? licen[cs]e,? v(?:ersion)?\.? ?2(?:\.0)?
91 | apache | apache-2.0 | apache 2(?:\.0)? licen[cs]ed?
88 | apache | apache-1.1 | (?:the )?apache software licen[cs]e version 1\.1
88 | apache | apache-1.0 | (?:the )?apache software licen[cs]e version 1\.0
80 | apache | apache | (?:released|distributed|available|licensed) under the apache licen[cs]e
70 | apache | apache | (?:the )?apache(?: software)? licen[cs]e
60 | asf | apache | licensed to the asf under one or more contributor license agreements
60 | apache software foundation | apache | licensed to the apache software foundation
94 | mit | mit | (?:licensed|released|distributed|available) under the (?:terms of the )?mit licen[cs]e
92 | mit | mit | the mit licen[cs]e \(?mit\)?
90 | mit | mit | mit licen[cs]ed?
90 | opensource | mit | opensource org licenses mit(?: license)?(?: php)?
86 | expat | mit | (?:the )?expat licen[cs]e
86 | x11 | x11 | (?:the )?(?:mit )?x11 licen[cs]e
94 | bsd | bsd-3-clause | (?:3|three)(?:-| )clause bsd licen[cs]e
94 | bsd | bsd-2-clause | (?:2|two)(?:-| )clause bsd licen[cs]e
94 | bsd | bsd-4-clause | (?:4|four)(?:-| )clause bsd licen[cs]e
93 | bsd | bsd-3-clause | bsd (?:3|three) clause (?:new or revised )?licen[cs]e
93 | bsd | bsd-2-clause | bsd (?:2|two) clause (?:simplified )?licen[cs]e
93 | bsd | bsd-0-clause | (?:zero|0) clause bsd licen[cs]e
92 | bsd | bsd-3-clause | (?:new|modified|revised) bsd licen[cs]e
92 | bsd | bsd-2-clause | (?:simplified|freebsd) (?:bsd )?licen[cs]e(?: [a-z0-9]+){0,6} bsd
91 | bsd | bsd-4-clause | (?:original|old) bsd licen[cs]e
90 | bsd | bsd | use of this source code is governed by a bsd style licen[cs]e
89 | bsd | bsd | (?:licensed|released|distributed|available) under the (?:terms of the )?bsd licen[cs]e
80 | bsd | bsd | bsd(?: style| type| like)? licen[cs]e
78 | freebsd | bsd-2-clause | freebsd (?:documentation )?licen[cs]e
96 | general public | gpl-3.0-or-later | gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
96 | general public | gpl-2.0-or-later | gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
95 | general public | gpl-2.0-only | gnu general public licen[cs]e version 2 as published by the free software foundation
95 | general public | gpl-3.0-only | gnu general public licen[cs]e version 3 as published by the free software foundation
94 | general public | gpl-3.0 | gnu general public licen[cs]e version 3(?:\.0)?(?: 29 june 2007)?
94 | general public | gpl-2.0 | gnu general public licen[cs]e version 2(?:\.0)?(?: june 1991)?
94 | general public | gpl-1.0 | gnu general public licen[cs]e version 1(?:\.0)?(?: february 1989)?
92 | gpl | gpl-3.0 | gpl v?3(?:\.0)? licen[cs]e
92 | gpl | gpl-2.0 | gpl v?2(?:\.0)? licen[cs]e
85 | general public | gpl | (?:under|by) the terms of the gnu general public licen[cs]e
84 | general public | gpl | you should have received a copy of the gnu general public licen[cs]e
80 | gnu | gpl | www gnu org licenses gpl(?: 2\.0| 3\.0)?(?: html| txt)?
75 | general public | gpl | (?:the )?gnu general public licen[cs]e
70 | general public | gpl | general public licen[cs]e
66 | gpl | gpl | gnu gpl licen[cs]e
96 | lesser general | lgpl-2.1-or-later | gnu lesser general public licen[cs]e as published by the free software foundation either version 2\.1 of the licen[cs]e or at your option any later version
96 | lesser general | lgpl-3.0-or-later | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
95 | library general | lgpl-2.0-or-later | gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
94 | lesser general | lgpl-2.1 | gnu lesser general public licen[cs]e version 2\.1(?: february 1999)?
94 | lesser general | lgpl-3.0 | gnu lesser general public licen[cs]e version 3(?:\.0)?(?: 29 june 2007)?
93 | library general | lgpl-2.0 | gnu library general public licen[cs]e version 2(?:\.0)?(?: june 1991)?
92 | lgpl | lgpl-2.1 | lgpl v?2\.1 licen[cs]e
92 | lgpl | lgpl-3.0 | lgpl v?3(?:\.0)? licen[cs]e
86 | lesser general | lgpl | you should have received a copy of the gnu lesser general public licen[cs]e
80 | gnu | lgpl | www gnu org licenses lgpl(?: 2\.1| 3\.0)?(?: html| txt)?
78 | lesser general | lgpl | (?:the )?gnu lesser general public licen[cs]e
77 | library general | lgpl | (?:the )?gnu library general public licen[cs]e
96 | affero | agpl-3.0-or-later | gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
95 | affero | agpl-3.0 | gnu affero general public licen[cs]e version 3(?:\.0)?(?: 19 november 2007)?
93 | affero | agpl-1.0 | affero general public licen[cs]e version 1
86 | affero | agpl | you should have received a copy of the gnu affero general public licen[cs]e
78 | affero | agpl | (?:the )?(?:gnu )?affero general public licen[cs]e
94 | free documentation | gfdl-1.3 | gnu free documentation licen[cs]e version 1\.3
94 | free documentation | gfdl-1.2 | gnu free documentation licen[cs]e version 1\.2
94 | free documentation | gfdl-1.1 | gnu free documentation licen[cs]e version 1\.1
80 | free documentation | gfdl | (?:the )?gnu free documentation licen[cs]e
78 | gnu | gfdl | www gnu org licenses fdl(?: 1\.\d)?(?: html| txt)?
96 | mozilla | mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2\.0
95 | mozilla | mpl-1.1 | the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
93 | mozilla | mpl-2.0 | mozilla public licen[cs]e v(?:ersion)? ?2\.0
93 | mozilla | mpl-1.1 | mozilla public licen[cs]e v(?:ersion)? ?1\.1
93 | mozilla | mpl-1.0 | mozilla public licen[cs]e v(?:ersion)? ?1\.0
76 | mozilla | mpl | (?:the )?mozilla public licen[cs]e
86 | netscape | npl | netscape public licen[cs]e(?: version 1\.[01])?
95 | eclipse | epl-2.0 | eclipse public licen[cs]e v(?:ersion)? ?2\.0
95 | eclipse | epl-1.0 | eclipse public licen[cs]e v(?:ersion)? ?1\.0
88 | eclipse | edl-1.0 | eclipse distribution licen[cs]e v(?:ersion)? ?1\.0
76 | eclipse | epl | (?:the )?eclipse public licen[cs]e
94 | common development | cddl-1.1 | common development and distribution licen[cs]e(?: cddl)? version 1\.1
94 | common development | cddl-1.0 | common development and distribution licen[cs]e(?: cddl)? version 1\.0
76 | common development | cddl | (?:the )?common development and distribution licen[cs]e
90 | common public attribution | cpal-1.0 | common public attribution licen[cs]e(?: version 1\.0)?
90 | common public | cpl-1.0 | common public licen[cs]e version 1\.0
89 | common public | cpl-0.5 | common public licen[cs]e version 0\.5
74 | common public | cpl | (?:the )?common public licen[cs]e
90 | ibm public | ipl-1.0 | ibm public licen[cs]e version 1\.0
92 | artistic | artistic-2.0 | artistic licen[cs]e (?:version )?2\.0
91 | artistic | artistic-1.0 | artistic licen[cs]e (?:version )?1\.0
90 | artistic | artistic-perl | same terms as perl itself(?: [a-z0-9]+){0,6} artistic licen[cs]e
88 | clarified artistic | artistic-clarified | clarified artistic licen[cs]e
74 | artistic | artistic | (?:the )?(?:perl )?artistic licen[cs]e
92 | isc | isc | (?:licensed|released|distributed|available) under the (?:terms of the )?isc licen[cs]e
88 | isc | isc | isc licen[cs]ed?
94 | boost | bsl-1.0 | (?:distributed|licensed) under the boost software licen[cs]e version 1\.0
92 | boost | bsl-1.0 | boost software licen[cs]e (?:version )?1\.0
90 | boost | bsl-1.0 | www boost org license 1 0 txt
76 | boost | bsl | (?:the )?boost(?: software)? licen[cs]e
94 | european union | eupl-1.2 | european union public licen[cs]e v(?:ersion)?\.? ?1\.2
94 | european union | eupl-1.1 | european union public licen[cs]e v(?:ersion)?\.? ?1\.1
94 | european union | eupl-1.0 | european union public licen[cs]e v(?:ersion)?\.? ?1\.0
84 | eupl | eupl | licensed under the eupl
76 | european union | eupl | (?:the )?european union public licen[cs]e
90 | cecill | cecill-2.1 | cecill(?: free software)? licen[cs]e(?: agreement)? version 2\.1
89 | cecill | cecill-b | cecill b(?: free software)? licen[cs]e
89 | cecill | cecill-c | cecill c(?: free software)? licen[cs]e
78 | cecill | cecill | (?:governed by the )?cecill(?: free software)? licen[cs]e
90 | zlib | zlib | zlib libpng licen[cs]e
88 | zlib | zlib | (?:the )?zlib licen[cs]e
88 | libpng | libpng | libpng licen[cs]e(?: version 2)?
92 | python software | psf-2.0 | python software foundation licen[cs]e (?:agreement )?(?:version )?2
90 | python software | psf | python software foundation licen[cs]e
86 | python | psf | psf licen[cs]e agreement for python \d(?:\.\d+)*
86 | php | php-3.01 | php licen[cs]e version 3\.01
85 | php | php-3.0 | php licen[cs]e version 3\.0
74 | php | php | (?:the )?php licen[cs]e
86 | ruby | ruby | (?:the )?ruby(?: s)? licen[cs]e
86 | vim | vim | (?:the )?vim licen[cs]e
86 | zope | zpl-2.1 | zope public licen[cs]e (?:zpl )?version 2\.1
84 | zope | zpl-2.0 | zope public licen[cs]e (?:zpl )?version 2\.0
74 | zope | zpl | (?:the )?zope public licen[cs]e
88 | openssl | openssl | (?:the )?openssl licen[cs]e
86 | ssleay | openssl | original ssleay licen[cs]e
86 | openldap | oldap | openldap public licen[cs]e(?: version \d(?:\.\d)*)?
86 | postgresql | postgresql | (?:the )?postgresql licen[cs]e
84 | tcl | tcl | tcl tk licen[cs]e
86 | w3c | w3c | w3c software (?:notice and |and document )?licen[cs]e
86 | unicode | unicode | unicode(?: inc)? licen[cs]e agreement
84 | icu | icu | icu licen[cs]e icu \d
88 | ncsa | ncsa | university of illinois ncsa open source licen[cs]e
80 | ncsa | ncsa | ncsa(?: open source)? licen[cs]e
94 | open data | odbl-1.0 | open data commons open database licen[cs]e(?: odbl)?(?: v?1\.0)?
92 | open database | odbl-1.0 | open database licen[cs]e(?: odbl)? v(?:ersion)? ?1\.0
80 | open database | odbl | (?:the )?open database licen[cs]e
90 | open data | odc-by-1.0 | open data commons attribution licen[cs]e(?: v?1\.0)?
90 | open data | pddl-1.0 | open data commons public domain dedication and licen[cs]e
88 | database contents | dbcl-1.0 | database contents licen[cs]e(?: dbcl)?(?: v?1\.0)?
90 | open government | ogl-3.0 | open government licen[cs]e v(?:ersion)? ?3\.0
90 | open government | ogl-2.0 | open government licen[cs]e v(?:ersion)? ?2\.0
78 | open government | ogl | (?:the )?open government licen[cs]e
86 | licence ouverte | etalab-2.0 | licence ouverte(?: open licence)?(?: version)? 2\.0
74 | licence ouverte | etalab | licence ouverte
86 | datenlizenz | dl-de-by-2.0 | datenlizenz deutschland namensnennung(?: version)? 2\.0(?: [a-z0-9]+){0,6} licen[cs]e
94 | open font | ofl-1.1 | sil open font licen[cs]e version 1\.1
93 | open font | ofl-1.0 | sil open font licen[cs]e version 1\.0
90 | sil | ofl-1.1 | scripts sil org ofl(?: [a-z0-9]+){0,6} licen[cs]e
78 | open font | ofl | (?:the )?(?:sil )?open font licen[cs]e
84 | gust font | gust | gust font licen[cs]e
86 | ubuntu font | ufl-1.0 | ubuntu font licen[cs]e(?: version 1\.0)?
92 | universal permissive | upl-1.0 | universal permissive licen[cs]e(?: upl)?(?: v(?:ersion)? ?1\.0)?
90 | academic free | afl-3.0 | academic free licen[cs]e v(?:ersion)?\.? ?3\.0
89 | academic free | afl-2.1 | academic free licen[cs]e v(?:ersion)?\.? ?2\.1
88 | academic free | afl-2.0 | academic free licen[cs]e v(?:ersion)?\.? ?2\.0
74 | academic free | afl | (?:the )?academic free licen[cs]e
90 | open software | osl-3.0 | open software licen[cs]e v(?:ersion)?\.? ?3\.0
89 | open software | osl-2.1 | open software licen[cs]e v(?:ersion)?\.? ?2\.1
74 | open software | osl | (?:the )?open software licen[cs]e
90 | microsoft | ms-pl | microsoft public licen[cs]e(?: ms pl)?
90 | microsoft | ms-rl | microsoft reciprocal licen[cs]e(?: ms rl)?
82 | microsoft | ms-eula | microsoft software licen[cs]e terms
82 | microsoft | ms-lpl | microsoft limited public licen[cs]e
90 | what the | wtfpl | do what the \w{2,10} you want to public licen[cs]e(?: version 2)?
86 | beer | beerware | the beer ?ware licen[cs]e(?: revision 42)?
86 | beer | beerware | beer ware licen[cs]e
84 | json | json | (?:the )?json licen[cs]e
84 | curl | curl | (?:the )?curl licen[cs]e
84 | sleepycat | sleepycat | sleepycat (?:public )?licen[cs]e
84 | qt public | qpl-1.0 | qt public licen[cs]e(?: version 1\.0)?
84 | reciprocal public | rpl-1.5 | reciprocal public licen[cs]e(?: 1\.5)?
84 | sun public | spl-1.0 | sun public licen[cs]e(?: version 1\.0)?
84 | sun industry | sissl | sun industry standards source licen[cs]e
84 | apple public | apsl-2.0 | apple public source licen[cs]e(?: version 2\.0)?
84 | nokia open | nokia | nokia open source licen[cs]e
84 | intel open | intel | intel open source licen[cs]e
84 | nasa open | nasa-1.3 | nasa open source agreement(?: [a-z0-9]+){0,6} licen[cs]e
84 | lucent public | lpl-1.02 | lucent public licen[cs]e(?: version 1\.02)?
84 | mulan | mulanpsl-2.0 | mulan permissive software licen[cs]e(?: version)? ?2
84 | mulan | mulanpsl-1.0 | mulan permissive software licen[cs]e(?: version)? ?1
84 | cern open | cern-ohl | cern open hardware licen[cs]e(?: v(?:ersion)? ?[12](?:\.\d)?)?
84 | tapr | tapr-ohl | tapr open hardware licen[cs]e
84 | solderpad | solderpad | solderpad hardware licen[cs]e
84 | free art | lal-1.3 | free art licen[cs]e(?: 1\.3)?
84 | blue oak | blueoak-1.0.0 | blue oak model licen[cs]e(?: 1\.0\.0)?
84 | server side public | sspl-1.0 | server side public licen[cs]e(?: v(?:ersion)? ?1)?
84 | business source | busl-1.1 | business source licen[cs]e(?: 1\.1)?
84 | elastic | elastic-2.0 | elastic licen[cs]e (?:version )?2\.0
76 | elastic | elastic | (?:the )?elastic licen[cs]e
84 | commons clause | commons-clause | commons clause licen[cs]e condition v?1\.0
84 | polyform | polyform-nc-1.0.0 | polyform noncommercial licen[cs]e(?: 1\.0\.0)?
84 | polyform | polyform-sb-1.0.0 | polyform small business licen[cs]e(?: 1\.0\.0)?
84 | parity public | parity-7.0 | parity public licen[cs]e(?: 7\.0)?
84 | hippocratic | hippocratic | hippocratic licen[cs]e(?: version)? ?\d(?:\.\d)?
84 | openrail | openrail | openrail m? ?licen[cs]e
84 | responsible ai | rail | responsible ai licen[cs]e
84 | llama | llama | llama \d(?:\.\d)? community licen[cs]e(?: agreement)?
84 | creativeml | creativeml-openrail-m | creativeml open rail m licen[cs]e
84 | anti 996 | anti-996 | anti 996 licen[cs]e
84 | educational community | ecl | educational community licen[cs]e
86 | educational community | ecl-2.0 | educational community licen[cs]e version 2\.0
84 | licence art libre | lal-1.3 | licence art libre(?: 1\.3)?
84 | deutsche freie | d-fsl | deutsche freie software lizenz(?: [a-z0-9]+){0,6} licen[cs]e
84 | computer associates | catosl | computer associates trusted open source licen[cs]e
84 | eu datagrid | eudatagrid | eu datagrid software licen[cs]e
84 | fair licen | fair | the fair licen[cs]e
84 | frameworx | frameworx-1.0 | frameworx open licen[cs]e
84 | historical permission | hpnd | historical permission notice and disclaimer(?: [a-z0-9]+){0,6} licen[cs]e
84 | motosoto | motosoto | motosoto open source licen[cs]e
84 | multics | multics | multics licen[cs]e
84 | naumen | naumen | naumen public licen[cs]e
84 | nethack | ngpl | nethack general public licen[cs]e
84 | non profit open | npos-3.0 | non profit open software licen[cs]e(?: 3\.0)?
84 | oclc | oclc-2.0 | oclc research public licen[cs]e(?: 2\.0)?
84 | open group | ogtsl | open group test suite licen[cs]e
84 | realnetworks | rpsl-1.0 | realnetworks public source licen[cs]e
84 | ricoh | rscpl | ricoh source code public licen[cs]e
84 | simple public | simpl-2.0 | simple public licen[cs]e(?: 2\.0)?
84 | vovida | vsl-1.0 | vovida software licen[cs]e
84 | wxwindows | wxwindows | wxwindows library licen[cs]e
84 | x net | xnet | x net licen[cs]e
84 | yahoo | ypl-1.1 | yahoo public licen[cs]e(?: version 1\.1)?
84 | xfree86 | xfree86-1.1 | xfree86 (?:project )?licen[cs]e(?: version 1\.1)?
84 | imagemagick | imagemagick | imagemagick licen[cs]e
84 | info zip | info-zip | info zip licen[cs]e
84 | independent jpeg | ijg | independent jpeg group(?: [a-z0-9]+){0,6} licen[cs]e
84 | freetype | ftl | (?:the )?freetype (?:project )?licen[cs]e
84 | latex project | lppl-1.3c | latex project public licen[cs]e(?: version 1\.3c?)?
84 | lppl | lppl | lppl version 1\.\d(?: [a-z0-9]+){0,6} licen[cs]e
84 | openoffice | sissl | openoffice org(?: [a-z0-9]+){0,6} public documentation licen[cs]e
84 | public documentation | pdl | public documentation licen[cs]e
84 | design science | dsl | design science licen[cs]e
84 | open publication | opl-1.0 | open publication licen[cs]e(?: v1\.0)?
84 | open content | opl | open content licen[cs]e
84 | against drm | adl | against drm licen[cs]e
84 | game licen | ogl-1.0a | open game licen[cs]e(?: version 1\.0a?)?
72 | dual | dual | dual(?:ly)? licensed under
66 | commercial | commercial | commercial licen[cs]e (?:agreement|terms|required)
66 | end user | eula | end user licen[cs]e agreement
64 | evaluation | evaluation | evaluation licen[cs]e
62 | site licen | site | site licen[cs]e
62 | royalty | royalty-free | royalty free licen[cs]e
62 | non exclusive | grant | non exclusive (?:worldwide |perpetual |irrevocable |royalty free ){1,4}licen[cs]e
58 | open source | open-source | open source licen[cs]e
56 | free software | free-software | free software licen[cs]e
54 | see the | license-file | see the (?:accompanying )?licen[cs]e (?:file|txt|md)
52 | terms | license-terms | (?:under|by|to) the terms (?:and conditions )?of (?:this|the) licen[cs]e
50 | unlicensed | unlicensed | unlicensed
[mit]
84 | mit | mit-0 | mit no attribution(?: licen[cs]e)?
[classpath]
75 | classpath | classpath-exception | gnu classpath(?: licen[cs]e)? exception
[gpl]
92 | gplv3 | gpl-3.0 | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv3
92 | gplv2 | gpl-2.0 | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gplv2
91 | gpl | gpl-2.0-or-later | gpl (?:version |v)?2 or later
91 | gpl | gpl-3.0-or-later | gpl (?:version |v)?3 or later
83 | gpl | gpl | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?gpl
84 | lgpl | lgpl | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?lgpl
84 | agpl | agpl | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:gnu )?agpl
[mozilla]
90 | mozilla | mpl-2.0 | (?:if a copy of the mpl was not distributed with this file )?you can obtain one at https? mozilla org mpl 2\.0
[bitstream]
84 | bitstream | bitstream-vera | bitstream vera (?:fonts )?(?:copyright|licen[cs]e)
[gemma]
84 | gemma | gemma | gemma (?:terms of use|licen[cs]e)
[spdx]
99 | spdx | spdx | spdx license identifier [a-z0-9.+\-]{2,40}(?: (?:or|and|with) [a-z0-9.+\-]{2,40}){0,4}
80 | spdx | spdx-copyright | spdx filecopyrighttext
78 | spdxversion | spdx-document | spdxversion spdx \d\.\d
[creative]
97 | creative commons | cc-by-4.0 | creative commons attribution 4\.0 (?:international )?(?:public )?licen[cs]e
97 | creative commons | cc-by-3.0 | creative commons attribution 3\.0 (?:unported |united states )?licen[cs]e
97 | creative commons | cc-by-sa-4.0 | creative commons attribution sharealike 4\.0 (?:international )?(?:public )?licen[cs]e
97 | creative commons | cc-by-sa-3.0 | creative commons attribution share ?alike 3\.0 (?:unported |united states )?licen[cs]e
97 | creative commons | cc-by-nc-4.0 | creative commons attribution non ?commercial 4\.0 (?:international )?(?:public )?licen[cs]e
97 | creative commons | cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s 4\.0 (?:international )?(?:public )?licen[cs]e
97 | creative commons | cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4\.0 (?:international )?(?:public )?licen[cs]e
97 | creative commons | cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4\.0 (?:international )?(?:public )?licen[cs]e
90 | creative commons | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?(?:s|works)?
90 | creative commons | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
89 | creative commons | cc-by-sa | creative commons attribution share ?alike
89 | creative commons | cc-by-nc | creative commons attribution non ?commercial
89 | creative commons | cc-by-nd | creative commons attribution no ?deriv(?:ative)?(?:s|works)?
86 | creative commons | cc-by | creative commons (?:by|attribution)
95 | creative commons | cc0-1.0 | creative commons (?:zero|cc0|0)(?: v?1\.0)?(?: universal)?
92 | creativecommons | cc-by-nc-nd | creativecommons org licenses by nc nd(?: \d\.\d)?
92 | creativecommons | cc-by-nc-sa | creativecommons org licenses by nc sa(?: \d\.\d)?
91 | creativecommons | cc-by-sa | creativecommons org licenses by sa(?: \d\.\d)?
91 | creativecommons | cc-by-nc | creativecommons org licenses by nc(?: \d\.\d)?
91 | creativecommons | cc-by-nd | creativecommons org licenses by nd(?: \d\.\d)?
90 | creativecommons | cc-by | creativecommons org licenses by(?: \d\.\d)?
92 | creativecommons | cc0-1.0 | creativecommons org publicdomain zero(?: 1\.0)?
90 | creativecommons | cc-pdm-1.0 | creativecommons org publicdomain mark(?: 1\.0)?
84 | creative commons | cc-sampling | creative commons sampling plus(?: 1\.0)?
70 | creative commons | cc | creative commons licen[cs]ed?
[cc]
93 | cc | cc-by-4.0 | cc by 4\.0
93 | cc | cc-by-3.0 | cc by 3\.0
93 | cc | cc-by-2.5 | cc by 2\.5
93 | cc | cc-by-2.0 | cc by 2\.0
93 | cc | cc-by-sa-4.0 | cc by sa 4\.0
93 | cc | cc-by-sa-3.0 | cc by sa 3\.0
93 | cc | cc-by-sa-2.5 | cc by sa 2\.5
93 | cc | cc-by-nc-4.0 | cc by nc 4\.0
93 | cc | cc-by-nc-3.0 | cc by nc 3\.0
93 | cc | cc-by-nd-4.0 | cc by nd 4\.0
93 | cc | cc-by-nc-sa-4.0 | cc by nc sa 4\.0
93 | cc | cc-by-nc-sa-3.0 | cc by nc sa 3\.0
93 | cc | cc-by-nc-nd-4.0 | cc by nc nd 4\.0
93 | cc | cc-by-nc-nd-3.0 | cc by nc nd 3\.0
86 | cc | cc-by-sa | cc by sa
86 | cc | cc-by-nc | cc by nc
86 | cc | cc-by-nd | cc by nd
88 | cc | cc-by-nc-sa | cc by nc sa
88 | cc | cc-by-nc-nd | cc by nc nd
90 | cc0 | cc0-1.0 | cc0(?: 1\.0)?(?: universal)?
[public]
92 | public domain | public-domain | (?:released|placed|dedicated|given) (?:in|into|to) the public domain
88 | public domain | public-domain | this (?:work|file|software|code|document|book) is (?:in|part of) the public domain
86 | public domain | public-domain | public domain dedication
84 | public domain | public-domain-mark | public domain mark
82 | public domain | public-domain | (?:not|no longer) (?:protected|subject) (?:by|to) copyright(?: [a-z0-9]+){0,6} public domain
72 | public domain | public-domain | (?:in|into|to) the public domain
84 | publicly | public-performance | not be publicly (?:performed|displayed)
[unencumbered]
97 | unencumbered | unlicense | this is free and unencumbered software released into the public domain
95 | unencumbered | unlicense | free and unencumbered software
[unlicense]
94 | unlicense | unlicense | (?:please refer to )?(?:https? )?unlicense org
90 | unlicense | unlicense | the unlicense
[permission]
97 | permission | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
92 | permission | mit | permission is hereby granted free of charge to any person
95 | permission | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
94 | permission | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
94 | permission | zlib | permission is granted to anyone to use this software for any purpose including commercial applications
93 | permission | gfdl | permission is granted to copy distribute and or modify this document under the terms of
90 | permission | ofl | permission is hereby granted free of charge to any person obtaining a copy of the font software
86 | permission | verbatim | permission is granted to (?:make and distribute|copy and distribute) verbatim copies
84 | permission | permission | (?:reprinted|reproduced|used) (?:by|with)(?: the)?(?: kind)? permission
80 | permission | restricted | without (?:the )?(?:prior |express |written |prior written |express written ){0,2}permission
78 | permission | restricted | (?:requires|subject to) prior (?:written )?permission
76 | permission | contact | (?:for )?permissions? (?:requests )?contact
[redistribut]
96 | redistribution | bsd | redistribution and use in source and binary forms with or without modification are permitted
94 | redistributions | bsd | redistributions of source code must retain the above copyright notice
94 | redistributions | bsd | redistributions in binary form must reproduce the above copyright notice
86 | redistribute | gpl | you can redistribute it and or modify it under the terms of
84 | redistribute | perl | you can redistribute it and or modify it under the same terms as perl itself
74 | redistribute | proprietary | do not (?:copy or )?redistribute
72 | redistribution | proprietary | (?:redistribution|unauthorized redistribution) (?:is )?(?:strictly )?prohibited
70 | redistribution | proprietary | not for redistribution
[endorse]
88 | endorse | bsd-3-clause | may be used to endorse or promote products derived from this software without
[advertising]
86 | advertising | bsd-4-clause | all advertising materials mentioning features or use of this software
[warrant]
88 | warranty | disclaimer | without warranty of any kind express or implied
87 | warranties | disclaimer | without warranties or conditions of any kind
86 | warranty | gpl-disclaimer | without even the implied warranty of merchantability or fitness for a particular purpose
84 | warranties | disclaimer | (?:any )?express or implied warranties including but not limited to
82 | warranties | disclaimer | disclaims? all (?:implied )?warranties
80 | warranty | disclaimer | comes with absolutely no warranty
78 | provided as | disclaimer | (?:is )?provided as is without (?:any )?warrant(?:y|ies)
70 | warrant | disclaimer | (?:no|without any) warrant(?:y|ies)
[provided]
72 | provided | disclaimer | (?:is )?provided (?:on an )?as is(?: basis)?
[supplied]
72 | supplied | disclaimer | (?:is )?supplied (?:on an )?as is(?: basis)?
[liab]
80 | liable | disclaimer | in no event shall the (?:authors?|copyright holders?|regents)(?: or (?:contributors|copyright holders?))? be liable
70 | liability | disclaimer | limitation of liability
68 | liable | disclaimer | shall not be (?:held )?liable for any (?:direct |indirect |incidental )?damages
[copyright]
90 | copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:present|(?:19|20)?\d\d)){0,8}
88 | copyright | copyright | (?:c )?copyright by
84 | copyright notice | notice | the above copyright notice and this permission notice shall be included
82 | copyrighted | copyright | copyrighted (?:material|work|by)
80 | copyright | copyright-holder | (?:the )?copyright (?:holders?|owners?)
78 | copyright law | copyright-law | (?:protected|infringe(?:s|ment)?|violat(?:es|ion)) (?:by|of) (?:international |united states )?copyright laws?
76 | copyright | no-copyright | no copyright(?: infringement)? (?:intended|is claimed)
74 | copyright | dmca | digital millennium copyright act
60 | copyright | copyright | copyright
[reserved]
66 | all rights | reserved | (?:copyright (?:[a-z0-9]+ ){0,6})?all rights (?:are )?reserved
64 | rights reserved | some-reserved | some rights reserved
62 | rights reserved | no-reserved | no rights reserved
[rights]
64 | rights | reversed | all rights reversed
62 | government | government | u ?s government (?:users )?restricted rights
60 | rights | moral | moral rights(?: [a-z0-9]+){0,6} (?:asserted|waived)
[left]
62 | copyleft | copyleft | copyleft(?: licen[cs]e| notice)?
[confidential]
80 | confidential | proprietary | (?:strictly |company )?confidential and proprietary
72 | confidential | proprietary | (?:strictly |company |commercially )confidential
68 | confidential | confidential | (?:this (?:document|message|email) is )?confidential(?: information)?
[proprietary]
80 | proprietary | proprietary | proprietary (?:software|license|information|rights|and confidential)
76 | proprietary | trade-secret | proprietary(?: [a-z0-9]+){0,6} trade secrets?
[distribut]
72 | distributed | disclaimer | (?:is )?distributed (?:on an )?as is(?: basis)?
76 | distribute | proprietary | do not (?:copy or )?distribute
74 | distribution | proprietary | not for (?:public )?distribution
[internal]
72 | internal | internal | (?:for )?internal (?:use|distribution) only
[commercial]
78 | only | non-commercial | (?:for )?non ?commercial (?:use|purposes?) only
74 | commercial | non-commercial | not for commercial use
70 | commercial | non-commercial | may not be used for commercial purposes
[reproduc]
80 | reproduced | restricted | no part of this (?:publication|book|work|document) may be reproduced
76 | reproduction | restricted | (?:unauthorized )?reproduction (?:in whole or in part )?(?:is )?(?:strictly )?prohibited
[trademark]
66 | trademark | trademark | (?:is a |are )?(?:registered )?trademarks? of
[patent]
66 | patent | patent | (?:protected by|covered by) (?:one or more )?(?:u s )?patents?
64 | patent | patent-pending | patents? pending
[fair]
70 | fair use | fair-use | fair use (?:act|notice|doctrine|under)
[terms]
66 | terms of | terms-of-use | (?:subject to|see|by using(?: [a-z0-9]+){0,6} agree to) (?:the |our )?terms of (?:use|service)
"""


@dataclass(frozen=True)
class Rule:
    root: str
    priority: int
    keyword: str
    label: str
    pattern: str

    @property
    def expression(self) -> str:
        return _whole(rf"(?:{self.pattern})(?![a-z0-9])")

    @property
    def gate(self) -> str:
        return _whole(self.keyword)


def _whole(pattern: str) -> str:
    return r"(?<![a-z0-9])" + pattern.replace(" ", BLANK)


def default_rules() -> tuple[Rule, ...]:
    """The rules in their order."""
    out, root = [], ""
    for line in RULES.strip().splitlines():
        if line.startswith("["):
            root = line[1:-1]
        else:
            priority, keyword, label, pattern = line.split(" | ", 3)
            out.append(Rule(root, int(priority), keyword, label, pattern))
    return tuple(out)
