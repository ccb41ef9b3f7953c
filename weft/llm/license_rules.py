"""Hand-written licence signatures over lower-case words with one space between them.

Each line: label | keywords that every match holds | priority, 0 to 3 | weight | regex. Written for this scanner; order
matters only between detections of one start, length and priority.
"""

SIGNATURES = r"""
apache-2.0 | apache you | 3 | 1.0 | licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2.0 | compliance licenses | 3 | 1.0 | you may not use this (?:file|work|software|project) except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at https? www apache org licenses licenses?
apache-2.0 | apache licenses | 3 | 1.0 | www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | asl | 2 | 0.9 | asl v?2(?: 0)?
apache-2.0 | unless required | 1 | 0.6 | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-2.0 | perpetual worldwide | 1 | 0.6 | perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e
apache-1.1 | apache foundation | 2 | 0.9 | this product includes software developed by the apache software foundation
apache | apache | 1 | 0.6 | apache (?:style|like|compatible) licen[sc]e
mit | copyright permission | 3 | 1.0 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | opensource mit | 3 | 1.0 | opensource org licenses mit(?: license)?(?: php| html)?
mit | mit | 3 | 1.0 | dual licensed under (?:the )?mit (?:and|or) (?:the )?(?:apache|gpl|bsd)(?: licen[sc]es?)?(?: v?[23](?: 0)?)?
mit | mit | 2 | 0.9 | mit (?:or|and) apache(?: 2 0)?
mit | mit | 2 | 0.9 | (?:the )?mit expat licen[sc]e|mit x11 style licen[sc]e|mit style licen[sc]e
mit | expat | 2 | 0.9 | expat licen[sc]e
mit-0 | mit | 3 | 1.0 | mit no attribution(?: licen[sc]e)?|mit 0 licen[sc]e
mit | fitness noninfringement | 1 | 0.5 | warranties of merchantability fitness for a particular purpose and noninfringement
mit | claim tort | 1 | 0.5 | liable for any claim damages or other liability whether in an action of contract tort or otherwise
bsd-2-clause | freebsd | 2 | 0.9 | (?:the )?freebsd licen[sc]e
bsd-2-clause | netbsd | 2 | 0.9 | (?:the )?netbsd licen[sc]e
bsd-2-clause | opensource bsd | 3 | 1.0 | opensource org licenses bsd 2 clause
bsd-3-clause | opensource bsd | 3 | 1.0 | opensource org licenses bsd 3 clause|opensource org licenses bsd license(?: php)?
bsd-3-clause | endorse contributors | 3 | 1.0 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | 3 | 1.0 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | redistributions retain | 2 | 0.9 | redistributions of source code must retain the above copyright notice
bsd | redistributions reproduce | 2 | 0.9 | redistributions in binary form must reproduce the above copyright notice
bsd | bsd | 1 | 0.7 | bsd (?:like|type|compatible|family) licen[sc]es?
bsd-0-clause | zero bsd | 3 | 1.0 | zero clause bsd(?: licen[sc]e)?
bsd-0-clause | 0bsd | 3 | 1.0 | 0bsd(?: licen[sc]e)?
bsd-3-clause-clear | clear bsd | 3 | 1.0 | clear bsd(?: licen[sc]e)?|bsd 3 clause clear
isc | disclaims warranties | 1 | 0.6 | the software is provided as is and the author disclaims all warranties with regard to this software
gpl | free software | 2 | 0.9 | this (?:program|library|package|file|code) is free software you can redistribute it and or modify it
gpl | gnu copy received | 2 | 0.9 | you should have received a copy of the gnu general public licen[sc]e
gpl | gnu gpl | 2 | 0.9 | gnu gpl(?: licen[sc]e)?(?: version)?(?: v?[123](?: 0)?)?
gpl | gpl | 1 | 0.8 | (?:under|with) (?:the )?(?:terms of )?(?:the )?gpl|gpl licen[sc]ed?|gpl compatible
gpl-2 | gplv2 | 3 | 1.0 | (?:gnu )?gplv2(?: only| or later)?
gpl-3 | gplv3 | 3 | 1.0 | (?:gnu )?gplv3(?: only| or later)?
gpl-2 | opensource gpl | 3 | 1.0 | opensource org licenses gpl 2 0
gpl-3 | opensource gpl | 3 | 1.0 | opensource org licenses gpl 3 0
gpl-2-classpath | classpath exception | 3 | 1.0 | (?:gpl(?: v?2)? with )?(?:the )?classpath exception
gpl-linking | linking exception | 2 | 0.9 | (?:gcc runtime library|special|static) linking exception
gpl | copyleft | 1 | 0.5 | (?:strong|weak) copyleft(?: licen[sc]e)?
gpl | gnu www licenses | 2 | 0.8 | see https? www gnu org licenses
gpl-3 | tivoization anti | 1 | 0.5 | anti tivoization
lgpl | lgpl | 1 | 0.8 | (?:gnu )?lgpl(?: licen[sc]ed?)?
lgpl-2.1 | lgplv2 | 3 | 1.0 | (?:gnu )?lgplv2(?: 1)?(?: only| or later)?
lgpl-3 | lgplv3 | 3 | 1.0 | (?:gnu )?lgplv3(?: only| or later)?
agpl | agpl | 1 | 0.8 | (?:gnu )?agpl(?: licen[sc]ed?)?
agpl-3 | agplv3 | 3 | 1.0 | (?:gnu )?agplv3(?: only| or later)?
agpl | remotely network | 1 | 0.6 | users interacting with it remotely through a computer network
gfdl | gfdl | 2 | 0.9 | gfdl(?: 1 [123])?
gfdl | invariant sections | 2 | 0.9 | with no invariant sections(?: no)? (?:with no )?front cover texts
mpl-2.0 | source subject mozilla | 3 | 1.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1 | contents subject mozilla | 3 | 1.0 | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0 | mpl | 3 | 1.0 | mpl v?2(?: 0)?
mpl-1.1 | mpl | 3 | 1.0 | mpl v?1 1
mpl | mpl | 1 | 0.7 | mpl licen[sc]ed?|mozilla mpl
mpl-2.0 | secondary incompatible | 1 | 0.6 | incompatible with secondary licen[sc]es
npl | netscape | 2 | 0.9 | netscape public licen[sc]e(?: version)?(?: 1 [01])?
epl-1.0 | eclipse epl | 3 | 1.0 | www eclipse org legal epl v10(?: html)?
epl-2.0 | eclipse epl | 3 | 1.0 | www eclipse org legal epl 2 0
epl | epl | 1 | 0.7 | epl(?: v?[12] 0)? licen[sc]ed?
edl | eclipse distribution | 3 | 1.0 | eclipse distribution licen[sc]e(?: v?1 0)?
cddl | cddl | 2 | 0.9 | glassfish cddl|cddl and gpl
ipl | ibm | 2 | 0.9 | ibm public licen[sc]e(?: version)?(?: 1 0)?
spl | sun | 2 | 0.9 | sun public licen[sc]e(?: version)?(?: 1 0)?
apsl | apple | 2 | 0.9 | apple public source licen[sc]e(?: version)?(?: 2 0)?
osl | open | 2 | 0.9 | open software licen[sc]e(?: v?(?:ersion )?3 0)?
afl | academic | 2 | 0.9 | academic free licen[sc]e(?: v?(?:ersion )?[23] [01])?
qpl | public | 2 | 0.9 | q public licen[sc]e
ecl | educational | 2 | 0.9 | educational community licen[sc]e(?: version)?(?: 2 0)?
ncsa | illinois | 2 | 0.9 | university of illinois(?: ncsa)? open source licen[sc]e
w3c | w3c | 2 | 0.9 | w3c software(?: and document)?(?: notice and)? licen[sc]e
unicode | unicode | 2 | 0.9 | unicode(?: inc)? licen[sc]e(?: agreement)?|unicode terms of use
icu | icu | 2 | 0.9 | icu licen[sc]e
curl | curl | 2 | 0.9 | curl licen[sc]e
libpng | libpng | 2 | 0.9 | libpng licen[sc]e(?: version)?(?: 2)?
ijg | independent jpeg | 2 | 0.9 | independent jpeg group s software|independent jpeg group licen[sc]e
tiff | libtiff | 2 | 0.9 | libtiff licen[sc]e
ftl | freetype | 2 | 0.9 | (?:the )?freetype(?: project)? licen[sc]e
vim | vim | 2 | 0.9 | vim licen[sc]e
tcl | tcl | 2 | 0.9 | tcl tk licen[sc]e|tcl licen[sc]e
perl | perl | 2 | 0.9 | (?:under )?the same terms as perl(?: itself| 5)?
ruby | ruby | 2 | 0.9 | (?:under )?(?:the )?same terms as ruby(?: itself)?
lua | lua | 1 | 0.7 | lua licen[sc]e
sqlite-blessing | forgiveness evil | 3 | 1.0 | may you do good and not evil may you find forgiveness for yourself and forgive others
json | evil good | 2 | 0.9 | the software shall be used for good not evil
beerware | buy beer | 3 | 1.0 | you can buy me a beer in return
beerware | ware beer | 3 | 1.0 | beer ware licen[sc]e
beerware | beerware | 3 | 1.0 | beerware licen[sc]e
postcardware | postcard | 2 | 0.8 | send (?:me|us) a postcard
wtfpl | fuck public | 3 | 1.0 | do what the fuck you want to public licen[sc]e
unlicense | unencumbered domain | 3 | 1.0 | this is free and unencumbered software released into the public domain
unlicense | unlicense | 3 | 1.0 | unlicense org|the unlicense
cc0 | creativecommons publicdomain | 3 | 1.0 | creativecommons org publicdomain zero 1 0
cc0 | dedication universal | 3 | 1.0 | cc0 1 0 universal public domain dedication
cc0 | waived rights | 2 | 0.9 | (?:has )?waived all copyright and related or neighbou?ring rights
public-domain | publicdomain mark | 3 | 1.0 | creativecommons org publicdomain mark 1 0
public-domain | domain | 2 | 0.8 | (?:dedicated|released|placed|donated) (?:in|in|into|to) the public domain
public-domain | domain | 2 | 0.8 | works? in the public domain
public-domain | copyright expired | 1 | 0.6 | copyright has expired|copyright (?:term )?expired
us-government | government | 2 | 0.8 | works? of the (?:united states|u s|us) government
cc-by | creativecommons by | 3 | 1.0 | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons sa | 3 | 1.0 | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | creativecommons nd | 3 | 1.0 | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | creativecommons nc | 3 | 1.0 | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | creativecommons nc sa | 3 | 1.0 | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons nc nd | 3 | 1.0 | creativecommons org licenses by nc nd [1-4] [05]
creative-commons | creative commons | 1 | 0.6 | (?:under )?(?:a )?creative commons licen[sc]e
creative-commons | creative commons | 1 | 0.6 | some rights reserved creative commons
creative-commons | deed | 1 | 0.5 | (?:commons|licen[sc]e) deed
cc-by-nc | attribution only | 1 | 0.6 | attribution non ?commercial(?: use)? only
ogl | open government | 2 | 0.9 | open government licen[sc]e(?: v?(?:ersion )?[123](?: 0)?)?
open-parliament | open parliament | 2 | 0.9 | open parliament licen[sc]e
etalab | ouverte | 2 | 0.9 | (?:etalab )?licence ouverte(?: etalab)?
etalab | etalab | 2 | 0.9 | etalab open licen[sc]e
dl-de-by | datenlizenz | 2 | 0.9 | datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?
odbl | odbl | 3 | 1.0 | odbl(?: v?1(?: 0)?)?
odbl | openstreetmap | 1 | 0.7 | openstreetmap contributors
odc-by | odc | 3 | 1.0 | odc by(?: v?1(?: 0)?)?
cdla-permissive | community data | 2 | 0.9 | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | community data sharing | 2 | 0.9 | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
ofl | scripts sil | 3 | 1.0 | scripts sil org ofl
ofl | ofl | 2 | 0.9 | ofl(?: version)? 1 [01]|ofl licen[sc]ed?
ofl | reserved font | 2 | 0.8 | with reserved font name
openrail | responsible | 2 | 0.9 | responsible ai(?: m)? licen[sc]e
openrail | rail | 2 | 0.9 | rail(?: m)? licen[sc]e
llama | llama | 2 | 0.9 | llama(?: [234])?(?: [123])? community licen[sc]e(?: agreement)?
gemma | gemma | 2 | 0.9 | gemma terms of use
model-weights | weights research | 1 | 0.6 | weights are (?:released|available|provided) for (?:non ?commercial )?research(?: use| purposes)?(?: only)?
research-only | research | 2 | 0.8 | (?:for )?(?:academic |non ?commercial )?research (?:use|purposes) only
evaluation-only | evaluation | 2 | 0.8 | (?:for )?evaluation (?:use|purposes) only
personal-use | personal | 2 | 0.7 | (?:for )?(?:your )?personal(?: and)? non ?commercial use(?: only)?
personal-use | personal | 1 | 0.6 | (?:for )?personal use only
educational-use | educational | 1 | 0.6 | (?:for )?educational (?:use|purposes) only
sspl | sspl | 2 | 0.9 | sspl(?: v?1)?
elastic | elv2 | 2 | 0.9 | elv2
busl | bsl | 2 | 0.9 | bsl 1 1
busl | change date | 1 | 0.6 | change date .{1,40}? change licen[sc]e
commons-clause | commons clause | 2 | 0.9 | commons clause(?: licen[sc]e)?(?: condition)?
polyform | polyform | 2 | 0.9 | polyform (?:noncommercial|shield|strict|perimeter|small business|internal use) licen[sc]e(?: 1 0 0)?
fsl | functional source | 2 | 0.9 | functional source licen[sc]e
prosperity | prosperity | 2 | 0.9 | prosperity public licen[sc]e(?: 3 0 0)?
parity | parity | 2 | 0.9 | parity public licen[sc]e(?: 7 0 0)?
hippocratic | hippocratic | 2 | 0.9 | hippocratic licen[sc]e
aladdin | aladdin | 2 | 0.9 | aladdin free public licen[sc]e
shareware | shareware | 1 | 0.7 | this (?:program|software) is shareware|shareware version
freeware | freeware | 1 | 0.7 | this (?:program|software) is freeware|freeware licen[sc]e
proprietary | proprietary information | 2 | 0.8 | (?:this )?software contains proprietary(?: and confidential)? information
proprietary | trade secrets | 2 | 0.8 | (?:confidential )?trade secrets of
proprietary | copying | 2 | 0.9 | unauthori[sz]ed copying of this (?:file|software|document|material)
proprietary | unpublished | 2 | 0.8 | unpublished (?:work|rights)(?: all rights)? reserved
proprietary | reverse engineer | 2 | 0.8 | (?:may not|shall not|not to|or) reverse engineer decompile or disassemble
eula | licensed not sold | 2 | 0.9 | (?:the )?software is licensed not sold
eula | agree software | 2 | 0.8 | by (?:installing|downloading|using|clicking)(?: or using)?(?: this| the)? software you agree
eula | transferable non | 2 | 0.8 | non exclusive non transferable(?: limited| revocable)? licen[sc]e
eula | subscription agreement | 1 | 0.6 | (?:software|master) subscription agreement
reserved | reproduction prohibited | 2 | 0.8 | (?:unauthori[sz]ed )?reproduction(?: in whole or in part)?(?: without .{1,40}?)? (?:is )?(?:strictly )?prohibited
reserved | reproduced part | 2 | 0.9 | no part of this (?:publication|book|document|work|article|website) may be reproduced
reserved | tous droits | 1 | 0.8 | tous droits reserves|tous droits réservés
reserved | alle rechte | 1 | 0.8 | alle rechte vorbehalten
reserved | derechos | 1 | 0.8 | todos los derechos reservados
no-scraping | scraping | 1 | 0.6 | (?:no|prohibits?) (?:web )?scraping(?: or data mining)?
no-mining | mining | 1 | 0.6 | text and data mining (?:is )?(?:not permitted|prohibited|reserved)
no-training | train | 1 | 0.7 | (?:may not|must not|not) be used to train (?:any )?(?:ai|artificial intelligence|machine learning|language)
copyright | copyright | 1 | 0.5 | copyright c (?:19|20)[0-9]{2} (?:19|20)[0-9]{2}|copyright (?:19|20)[0-9]{2} by
copyright | copyrighted | 0 | 0.4 | copyrighted (?:material|work|content)
copyright | dmca | 0 | 0.4 | dmca(?: takedown| notice| policy)?
fair-use | fair | 0 | 0.4 | fair (?:use|dealing)(?: doctrine| notice)?
attribution | credit | 0 | 0.4 | (?:please )?(?:give|giving) (?:appropriate )?credit(?: to)?
attribution | reprinted | 1 | 0.5 | reprinted from|reprinted courtesy of
press-agency | associated press | 1 | 0.6 | (?:c )?(?:the )?associated press(?: all rights reserved)?
press-agency | broadcast rewritten | 2 | 0.8 | this material may not be published broadcast rewritten or redistributed
arxiv | arxiv perpetual | 2 | 0.8 | arxiv(?: org)? perpetual non ?exclusive licen[sc]e
open-access | access | 1 | 0.6 | open access article|published open access
open-access | unrestricted reproduction | 2 | 0.8 | permits unrestricted use distribution and reproduction in any medium
elsevier-user | elsevier | 1 | 0.7 | elsevier user licen[sc]e
acm | acm | 1 | 0.7 | permission to make digital or hard copies .{1,60}? acm|acm copyright
ieee | ieee | 1 | 0.6 | personal use of this material is permitted .{1,30}? ieee
stackexchange | contributions licensed | 1 | 0.6 | user contributions licensed under
wikipedia | wikipedia | 1 | 0.6 | text is available under .{1,60}? wikipedia
spdx | spdx | 2 | 0.9 | spdx licen[sc]e identifier
""".strip()


def signatures() -> list[tuple[str, tuple[str, ...], str, int, float]]:
    """(label, keywords, regex, priority, weight) of every line; keywords are those that every match holds."""
    out = []
    for line in SIGNATURES.splitlines():
        label, keywords, priority, weight, regex = (x.strip() for x in line.split(" | ", 4))
        out.append((label, tuple(keywords.split()), regex, int(priority), float(weight)))
    return out
