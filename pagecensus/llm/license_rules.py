"""Signature rules of licenses over a text's words (lower case, one blank between words).

A rule is gated by a literal phrase that has to occur, and has a priority (lower goes first) and a
confidence.  Notices, grants, clauses and headers are written out; names with their versions and tags
follow from a table of names, versions and ways to refer to them.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Identifier: names it goes by, its versions.
VERSIONED = {
    "gpl": (["gnu general public license", "gnu general public licence", "general public license", "gnu gpl", "gpl"], "1.0 2.0 3.0"),
    "lgpl": (["gnu lesser general public license", "gnu library general public license", "lesser general public license",
              "gnu lgpl", "lgpl"], "2.0 2.1 3.0"),
    "agpl": (["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], "1.0 3.0"),
    "gfdl": (["gnu free documentation license", "gfdl"], "1.1 1.2 1.3"),
    "apache": (["apache license", "apache software license", "apache licence", "apache"], "1.0 1.1 2.0"),
    "mpl": (["mozilla public license", "mpl"], "1.0 1.1 2.0"),
    "epl": (["eclipse public license", "epl"], "1.0 2.0"),
    "cddl": (["common development and distribution license", "cddl"], "1.0 1.1"),
    "eupl": (["european union public licence", "european union public license", "eupl"], "1.0 1.1 1.2"),
    "osl": (["open software license", "osl"], "1.0 2.0 2.1 3.0"),
    "afl": (["academic free license", "afl"], "1.1 1.2 2.0 2.1 3.0"),
    "artistic": (["artistic license", "perl artistic license"], "1.0 2.0"),
    "bsl": (["boost software license"], "1.0"),
    "ofl": (["sil open font license", "open font license"], "1.0 1.1"),
    "zpl": (["zope public license", "zpl"], "1.1 2.0 2.1"),
    "cpl": (["common public license"], "1.0"),
    "lppl": (["latex project public license", "lppl"], "1.0 1.1 1.2"),
    "php": (["php license"], "3.0 3.01"),
    "psf": (["python software foundation license", "psf license"], "2.0"),
    "upl": (["universal permissive license"], "1.0"),
    "apsl": (["apple public source license"], "1.0 1.1 2.0"),
    "odbl": (["open database license", "odbl"], "1.0"),
    "cecill": (["cecill"], "1.0 1.1 2.0 2.1"),
    "bdl": (["business source license"], "1.0 1.1"),
}
_CC_TERMS = ["", "nc", "nd", "sa", "nc nd", "nc sa"]
_CC_WORDS = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
for _terms in _CC_TERMS:
    _long = " ".join(_CC_WORDS[t] for t in _terms.split())
    VERSIONED["-".join(["cc-by", *_terms.split()])] = (
        [f"cc by {_terms}".strip(), f"creative commons attribution {_long}".strip()], "1.0 2.0 2.5 3.0 4.0"
    )
UNVERSIONED = {
    "mit": ["mit license", "mit licence", "mit licensed", "expat license"],
    "x11": ["x11 license"],
    "isc": ["isc license", "isc licence"],
    "zlib": ["zlib license", "zlib libpng license"],
    "bsd": ["bsd license", "bsd licence", "bsd style license"],
    "bsd-2-clause": ["bsd 2 clause", "simplified bsd license", "freebsd license", "two clause bsd"],
    "bsd-3-clause": ["bsd 3 clause", "new bsd license", "revised bsd license", "modified bsd license", "three clause bsd"],
    "bsd-4-clause": ["bsd 4 clause", "original bsd license"],
    "unlicense": ["the unlicense", "unlicense org"],
    "cc0-1.0": ["cc0 1 0", "cc0", "creative commons zero"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license"],
    "ms-pl": ["microsoft public license"],
    "ms-rl": ["microsoft reciprocal license"],
    "ncsa": ["university of illinois open source license", "ncsa open source license"],
    "postgresql": ["postgresql license"],
    "openssl": ["openssl license"],
    "ruby": ["ruby license"],
    "vim": ["vim license"],
    "curl": ["curl license"],
    "beerware": ["beerware license", "beer ware license"],
    "json": ["json license"],
    "public-domain": ["released into the public domain", "dedicated to the public domain", "placed in the public domain"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}
#: Sentences of license texts: identifier, the literal that gates the rule, the pattern.
TEXTS = [
    ("mit", "permission is hereby granted free of charge",
     r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){0,12}"),
    ("isc", "permission to use copy modify and",
     r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms",
     r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote products",
     r"neither the name of(?: \S+){1,16} endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials",
     r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "this software is provided as is",
     r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2.0", "you may not use this file except in compliance",
     r"you may not use this file except in compliance with the license"),
    ("gpl", "it under the terms of the gnu general public license",
     r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "it under the terms of the gnu lesser general public license",
     r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "it under the terms of the gnu affero general public license",
     r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license",
     r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software",
     r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute", r"everyone is permitted to copy and distribute verbatim or modified copies"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law(?: \S+){1,12} waived all copyright"),
]


# Fixed wordings: notices, grants, clauses, warranties and headers as licenses ask authors to write
# them, in words without punctuation.  Identifier, gate, pattern.
_FSF = r"as published by the free software foundation"
NOTICES = [
    ("gpl-1.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 1(?: 0)? or at your option any later version"),
    ("gpl-1.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 1(?: 0)? of the license or at your option any later version"),
    ("gpl-2.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 2(?: 0)? of the license or at your option any later version"),
    ("gpl-2.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 2(?: 0)? or at your option any later version"),
    ("gpl-3.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 3(?: 0)? of the license or at your option any later version"),
    ("gpl-3.0-or-later", "general public license as published by", rf"gnu general public license {_FSF} either version 3(?: 0)? or at your option any later version"),
    ("gpl-2.0-only", "general public license version 2 as published by", rf"gnu general public license version 2 {_FSF}"),
    ("gpl-3.0-only", "general public license version 3 as published by", rf"gnu general public license version 3 {_FSF}"),
    ("gpl-2.0-only", "general public license as published by", rf"gnu general public license {_FSF} version 2(?: of the license)?(?: only)?"),
    ("gpl-3.0-only", "general public license as published by", rf"gnu general public license {_FSF} version 3(?: of the license)?(?: only)?"),
    ("gpl-2.0-only", "version 2 of the license only", r"general public license(?: \S+){0,8} version 2 of the license only"),
    ("gpl-2.0-only", "gplv2 only", r"gplv2 only"),
    ("gpl-3.0-only", "gplv3 only", r"gplv3 only"),
    ("gpl-2.0-or-later", "gplv2 or later", r"gplv2 or (?:any )?later"),
    ("gpl-3.0-or-later", "gplv3 or later", r"gplv3 or (?:any )?later"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?"),
    ("lgpl-3.0", "lgplv3", r"lgplv3"),
    ("agpl-3.0", "agplv3", r"agplv3"),
    ("lgpl-2.0-or-later", "library general public license as published by", rf"gnu library general public license {_FSF} either version 2(?: 0)? of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser general public license as published by", rf"gnu lesser general public license {_FSF} either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "lesser general public license as published by", rf"gnu lesser general public license {_FSF} either version 2 1 or at your option any later version"),
    ("lgpl-3.0-or-later", "lesser general public license as published by", rf"gnu lesser general public license {_FSF} either version 3(?: 0)? of the license or at your option any later version"),
    ("lgpl-2.1-only", "lesser general public license as published by", rf"gnu lesser general public license {_FSF} version 2 1(?: of the license)?(?: only)?"),
    ("lgpl-3.0-only", "lesser general public license as published by", rf"gnu lesser general public license {_FSF} version 3(?: of the license)?(?: only)?"),
    ("agpl-3.0-or-later", "affero general public license as published by", rf"gnu affero general public license {_FSF} either version 3(?: 0)? of the license or at your option any later version"),
    ("agpl-3.0-only", "affero general public license as published by", rf"gnu affero general public license {_FSF} version 3(?: of the license)?(?: only)?"),
    ("agpl-1.0-or-later", "affero general public license as published by", r"affero general public license as published by affero inc either version 1 of the license or at your option any later version"),
    ("gfdl-1.1-or-later", "free documentation license version 1 1 or any later", r"gnu free documentation license version 1 1 or any later version published by the free software foundation"),
    ("gfdl-1.2-or-later", "free documentation license version 1 2 or any later", r"gnu free documentation license version 1 2 or any later version published by the free software foundation"),
    ("gfdl-1.3-or-later", "free documentation license version 1 3 or any later", r"gnu free documentation license version 1 3 or any later version published by the free software foundation"),
    ("gfdl", "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl", "you should have received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this (?:program|library|software|file|package)"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with this (?:program|library|software|file|package)"),
    ("lgpl", "you should have received a copy of the gnu library general public license", r"you should have received a copy of the gnu library general public license along with this (?:program|library|software|file|package)"),
    ("agpl", "you should have received a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with this (?:program|library|software|file|package)"),
    ("gpl", "without even the implied warranty of merchantability", r"see the gnu general public license for more details"),
    ("lgpl", "see the gnu lesser general public license", r"see the gnu lesser general public license for more details"),
    ("agpl", "see the gnu affero general public license", r"see the gnu affero general public license for more details"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "the licenses for most software are designed", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("lgpl-2.1", "this license the lesser general public license", r"this license the lesser general public license applies to some specially designated software packages"),
    ("gpl-with-classpath-exception", "linking this library statically or dynamically", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-linking-exception", "permission to link", r"(?:gives|grants|give|grant) (?:you )?permission to link (?:the code of )?(?:this|the) (?:program|library|software)"),
    ("gpl-with-font-exception", "embed this font", r"if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("gpl-with-gcc-exception", "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-with-autoconf-exception", "configuration script generated by autoconf", r"distribute (?:this file|it) as part of a program that contains a configuration script generated by autoconf"),
    ("gpl-with-bison-exception", "bison parser skeleton", r"so long as that work isn t itself a parser generator using the skeleton|create a larger work that contains part or all of the bison parser skeleton"),
    ("linux-syscall-note", "normal use of the kernel", r"user programs that use kernel services by normal system calls this is merely considered normal use of the kernel"),
    ("apache-2.0", "licensed under the apache license version 2 0", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "apache org licenses license 2 0", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "without warranties or conditions of any kind", r"without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "the asf licenses this file to you", r"the asf licenses this file to you under the apache license version 2 0"),
    ("apache-2.0", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution", r"terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache", r"the names apache(?: \S+){1,8} must not be used to endorse or promote products derived from this software"),
    ("apache-1.0", "developed by the apache group", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("llvm-exception", "llvm exceptions to the apache 2 0 license", r"llvm exceptions to the apache 2 0 license"),
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "shall be included in all copies or substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "arising from out of or in connection with the software", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mit", "opensource org licenses mit", r"opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", "use of this source code is governed by an mit style", r"use of this source code is governed by an mit style license"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("mit-advertising", "shall not be used in advertising or otherwise to promote the sale", r"except as contained in this notice the name of(?: \S+){1,8} shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "the name of the x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("mit", "permission to use copy modify distribute and sell this software", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("isc", "the software is provided as is and the author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", "the software is provided as is and isc disclaims", r"the software is provided as is and isc disclaims all warranties with regard to this software"),
    ("isc", "in no event shall the author be liable", r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("isc", "provided that the above copyright notice and this permission notice appear", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "bsd zero clause license", r"(?:bsd zero clause license|zero clause bsd)"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "this software is provided by the copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the regents and contributors", r"this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "as is and any express or implied warranties", r"this software is provided by the author(?:s)?(?: and contributors)? as is and any express or implied warranties"),
    ("bsd", "in no event shall the copyright owner or contributors be liable", r"in no event shall the copyright (?:owner|holder) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "use of this source code is governed by a bsd style", r"use of this source code is governed by a bsd style license(?: that can be found in the license file)?"),
    ("bsd-3-clause", "the name of the author may not be used to endorse", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "names of its contributors may be used to endorse", r"nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-2-clause", "should not be interpreted as representing official policies", r"should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd-4-clause", "this product includes software developed by the university of california", r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "not designed licensed or intended for use", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-source-code", "must retain all copyright notices and this condition", r"redistributions of source code must retain all copyright notices and this condition"),
    ("zlib", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "the origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "this notice may not be removed or altered from any source", r"this notice may not be removed or altered from any source distribution"),
    ("libpng", "the png reference library is supplied as is", r"the png reference library is supplied as is"),
    ("bsl-1.0", "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
    ("bsl-1.0", "boost org license 1 0", r"boost org license 1 0 txt"),
    ("bsl-1.0", "machine executable object code generated by a source language processor", r"solely in the form of machine executable object code generated by a source language processor"),
    ("mpl-2.0", "mozilla org mpl 2 0", r"(?:if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?)?mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1(?: the license)?"),
    ("mpl-1.0", "subject to the mozilla public license version 1 0", r"the contents of this file are subject to the mozilla public license version 1 0(?: the license)?"),
    ("mpl-1.1", "you may obtain a copy of the license at http www mozilla org mpl", r"you may obtain a copy of the license at https? www mozilla org mpl"),
    ("mpl-tri-license", "alternatively the contents of this file may be used under the terms of either", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl-1.1", "subject to the netscape public license", r"subject to the netscape public license version 1 1"),
    ("epl-1.0", "terms of the eclipse public license v1 0", r"(?:made available )?under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "terms of the eclipse public license 2 0", r"(?:made available )?under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse org legal epl v10", r"eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse org legal epl 2 0", r"eclipse org legal epl 2 0"),
    ("epl-2.0", "this source code may also be made available under the following secondary licenses", r"this source code may also be made available under the following secondary licenses"),
    ("edl-1.0", "eclipse distribution license", r"eclipse distribution license v(?: ?1 0|1 0|10)"),
    ("cpl-1.0", "terms of the common public license", r"under the terms of the common public license(?: v(?:ersion)? ?1 0)?"),
    ("ipl-1.0", "ibm public license", r"ibm public license(?: version 1 0)?"),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", r"subject to the terms of the common development and distribution license(?: the license)?"),
    ("cddl-1.0", "opensolaris license", r"usr src opensolaris license|opensolaris org os licensing"),
    ("cddl-1.1", "glassfish", r"glassfish (?:dev java net|java net) public cddl gpl 1 1 html"),
    ("eupl-1.1", "licensed under the eupl version 1 1", r"licensed under the eupl version 1 1(?: or as soon they will be approved by the european commission subsequent versions)?"),
    ("eupl-1.2", "licensed under the eupl version 1 2", r"licensed under the eupl version 1 2(?: or as soon they will be approved by the european commission subsequent versions)?"),
    ("osl-3.0", "licensed under the open software license version 3 0", r"licensed under the open software license version 3 0"),
    ("osl-2.1", "licensed under the open software license version 2 1", r"licensed under the open software license version 2 1"),
    ("afl-2.1", "licensed under the academic free license version 2 1", r"licensed under the academic free license version 2 1"),
    ("afl-3.0", "licensed under the academic free license version 3 0", r"licensed under the academic free license version 3 0"),
    ("artistic-perl", "under the same terms as perl itself", r"(?:redistribute it and or modify it )?under the same terms as perl(?: 5)?(?: itself)?"),
    ("artistic-1.0", "the intent of this document is to state the conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "the artistic license 2 0", r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "scripts sil org ofl", r"scripts sil org ofl"),
    ("ofl-1.1", "the ofl allows the licensed fonts", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely as long as they are not sold by themselves"),
    ("ofl-1.1", "reserved font name", r"with reserved font name(?: \S+){1,4}"),
    ("ubuntu-font-1.0", "ubuntu font licence", r"ubuntu font licence(?: version)? 1 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0", r"licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-3.0", "licensed under a creative commons attribution 3 0", r"licensed under a creative commons attribution 3 0 (?:unported|united states) license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0", r"licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa-3.0", "licensed under a creative commons attribution sharealike 3 0", r"licensed under a creative commons attribution sharealike 3 0 (?:unported|united states) license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0", r"licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa-4.0", "licensed under a creative commons attribution noncommercial sharealike 4 0", r"licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4.0", "licensed under a creative commons attribution noncommercial noderivatives 4 0", r"licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0", r"licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.5", "creativecommons org licenses by 2 5", r"creativecommons org licenses by 2 5"),
    ("cc-by-2.0", "creativecommons org licenses by 2 0", r"creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-2.5", "creativecommons org licenses by sa 2 5", r"creativecommons org licenses by sa 2 5"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-3.0", "creativecommons org licenses by nc 3 0", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "creativecommons org licenses by nc sa 3 0", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", "creativecommons org licenses by nc nd 3 0", r"creativecommons org licenses by nc nd 3 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons org publicdomain mark 1 0", r"creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "cc0 1 0 universal", r"cc0 1 0 universal(?: public domain dedication)?"),
    ("unlicense", "for more information please refer to", r"for more information please refer to https? unlicense org"),
    ("unlicense", "anyone is free to copy modify publish use compile sell", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("public-domain", "in the public domain", r"this (?:software|code|file|work|program|document) is in the public domain"),
    ("public-domain", "hereby placed in the public domain", r"hereby placed in the public domain"),
    ("public-domain", "the author disclaims copyright to this source code", r"the author disclaims copyright to this source code"),
    ("blessing", "in place of a legal notice here is a blessing", r"in place of a legal notice here is a blessing"),
    ("wtfpl", "you just do what the fuck you want to", r"you just do what the fuck you want to"),
    ("beerware", "you can buy me a beer in return", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "shall be used for good not evil", r"the software shall be used for good not evil"),
    ("ms-pl", "this license governs use of the accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-pl", "subject to the microsoft public license", r"subject to the microsoft public license"),
    ("ncsa", "to deal with the software without restriction", r"to deal with the software without restriction"),
    ("postgresql", "university of california be liable to any party", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", "this product includes software developed by the openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "subject to version 3 01 of the php license", r"this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "subject to version 3 0 of the php license", r"this source file is subject to version 3 0 of the php license"),
    ("zpl-2.1", "subject to the provisions of the zope public license version 2 1", r"subject to the provisions of the zope public license version 2 1"),
    ("zpl-2.0", "subject to the provisions of the zope public license version 2 0", r"subject to the provisions of the zope public license version 2 0"),
    ("psf-2.0", "psf is making python available to licensee", r"psf is making python available to licensee on an as is basis"),
    ("ruby", "under the same terms as ruby", r"(?:distributed |licensed )?under the same terms as ruby(?: itself)?"),
    ("lppl-1.3c", "conditions of the latex project public license", r"distributed and or modified under the conditions of the latex project public license either version 1 3c?(?: of this license)?(?: or at your option any later version)?"),
    ("w3c", "w3c software notice and license", r"w3c(?: r)? software(?: and document)? notice and license"),
    ("upl-1.0", "the universal permissive license upl", r"the universal permissive license upl version 1 0"),
    ("odbl-1.0", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons org licenses by", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons org licenses pddl", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-3.0", "open government licence v3 0", r"open government licence v3 0"),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: open licence)?(?: version)? 2 0"),
    ("cecill-2.1", "governed by the cecill license", r"governed by the cecill license under french law"),
    ("cecill-b", "governed by the cecill b license", r"governed by the cecill b license under french law"),
    ("cecill-c", "governed by the cecill c license", r"governed by the cecill c license under french law"),
    ("sspl-1.0", "server side public license", r"server side public license(?: version 1| v1)?"),
    ("elastic-2.0", "elastic license 2 0", r"elastic license 2 0"),
    ("elastic-1.0", "licensed under the elastic license", r"licensed under the elastic license"),
    ("bdl-1.1", "use of this software is governed by the business source license", r"use of this software is governed by the business source license(?: included in the license file)?"),
    ("commons-clause", "commons clause license condition", r"commons clause license condition v1 0"),
    ("polyform-noncommercial", "polyform noncommercial license", r"polyform noncommercial license 1 0 0"),
    ("hippocratic-2.1", "hippocratic license", r"hippocratic license(?: version)? 2 1"),
    ("openrail", "responsible ai license", r"(?:creativeml )?open(?: and)? responsible ai license|open rail m license|openrail m"),
    ("llama-community", "llama 2 community license agreement", r"llama (?:2|3) community license agreement"),
    ("proprietary", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade secrets", r"contains (?:proprietary information and )?trade secrets of(?: \S+){1,4}"),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|work|book) may be reproduced(?: \S+){0,12} without(?: the)? prior written permission"),
    ("proprietary", "end user license agreement", r"end user license agreement"),
    ("proprietary", "for personal non commercial use only", r"for personal non commercial use only"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    gate: str
    pattern: str
    confidence: float


def _version(version: str) -> str:
    """How a version is written: '3.0' as 3, 3 0, v3, version 3 0; '2.1' with both parts."""
    major, minor = version.split(".")
    digits = rf"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"
    return rf"(?:version |ver |v |v)?{digits}"


def rules() -> list[Rule]:
    """All rules, in order of priority: texts and tags, versions with "or later", versions, names."""
    found = [Rule(label, 0, gate, pattern, 1.0) for label, gate, pattern in [*TEXTS, *NOTICES]]
    for label, (names, versions) in VERSIONED.items():
        for version in versions.split():
            full = f"{label}-{version}"
            tag = " ".join(full.replace("-", " ").replace(".", " ").split())
            found.append(Rule(full, 0, "spdx license identifier", f"spdx license identifier {tag}(?: only)?", 1.0))
            for name in names:
                numbered = rf"{name}(?: international| unported)?(?: the)? {_version(version)}(?: international| unported)?"
                later = r"(?: \(?or)(?: at your option)?(?: any)? (?:later|newer|greater)(?: versions?)?"
                found.append(Rule(f"{full}-or-later", 1, name, numbered + later, 0.95))
                found.append(Rule(full, 2, name, numbered, 0.95))
        found += [Rule(label, 4, name, name, 0.6) for name in names if len(name.split()) > 1]
    for label, names in UNVERSIONED.items():
        tag = label.replace("-", " ").replace(".", " ")
        found.append(Rule(label, 0, "spdx license identifier", f"spdx license identifier {tag}", 1.0))
        for name in names:
            found.append(Rule(label, 2, name, rf"(?:licensed|released|distributed|available|published) under(?: the)? {name}", 0.9))
            found.append(Rule(label, 4, name, name, 0.7))
    return sorted(found, key=lambda r: (r.priority, r.label, r.gate))
