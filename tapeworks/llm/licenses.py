"""Operator 10: license scans by ordered signature rules.

A text becomes its lower-cased words joined by single blanks.  ``TEXTS`` and ``SIGNATURES`` are signatures of license texts:
titles, grants, conditions and disclaimers, by license and version.  Every family of licenses gives rules for its
name as well (an SPDX tag, a notice, a versioned name, an address, a bare mention), in order of priority.  A rule is tried only if
one of its keywords occurs (every wording that it matches holds one), which one Aho-Corasick pass over the text decides
for all rules.  Detections are taken by priority,
then length; one whose interval lies within that of a detection already taken is suppressed.  Signatures of license
texts come after tags and before notices.  Time is in proportion to a text's length, but for a logarithm.

The base phrases are counted and labelled whatever the rules find.  A null or empty text has no words, no labels and
score 0; a repeated row has the same result each time; an empty table gives an empty one.  Columns of the documents that
are named as ``scan``'s own are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeworks.llm.words import append_columns

#: Phrases that are always counted, and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, keywords (one for each wording of the name), name as a pattern over words, address as words (or none).
#: A keyword of more than three letters may start a word; a shorter one is a whole word.  Patterns see UTF-8 as Latin-1.
FAMILIES = (
    ("apache", "apache", "apache(?: software)?", "apache org licenses"),
    ("mit", "mit|expat", "mit|expat", "opensource org licenses mit"),
    ("bsd", "bsd", "(?:(?:new|modified|revised|simplified|original|[0234] clause) )?bsd(?: [0234] clause)?", "opensource org licenses bsd"),
    ("isc", "isc", "isc", "opensource org licenses isc"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "gnu org licenses lgpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?:v[23])?", "gnu org copyleft lesser"),
    ("lgpl", "library", "(?:gnu )?library general public", None),
    ("agpl", "affero", "(?:gnu )?affero general public", "gnu org licenses agpl"),
    ("agpl", "agpl", "(?:gnu )?agpl(?:v3)?", None),
    ("gpl", "general", "(?:gnu )?general public", "gnu org licenses gpl"),
    ("gpl", "gpl|gplv", "(?:gnu )?gpl(?:v[123])?", "gnu org copyleft gpl"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "gnu org licenses fdl"),
    ("mpl", "mozilla", "mozilla public", "mozilla org mpl"),
    ("mpl", "mpl", "mpl", None),
    ("epl", "eclipse", "eclipse public", "eclipse org legal epl"),
    ("edl", "eclipse", "eclipse distribution", None),
    ("cddl", "cddl", "cddl", None),
    ("cddl", "common", "common development and distribution", None),
    ("cpl", "common", "common public", None),
    ("cpal", "attribution", "common public attribution", None),
    ("artistic", "artistic", "(?:perl |clarified )?artistic", "opensource org licenses artistic"),
    ("boost", "boost", "boost software", "boost org license"),
    ("zlib", "zlib", "zlib(?: libpng)?", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", None),
    ("cc0", "cc0", "cc0", "creativecommons org publicdomain zero"),
    ("cc0", "zero", "creative commons zero|cc zero", None),
    ("cc-by-nc-nd", "nd", "(?:cc|creative commons) by nc nd", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "sa", "(?:cc|creative commons) by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc(?! (?:sa|nd) )", "creativecommons org licenses by nc [0-9]"),
    ("cc-by-nc-nd", "noderivatives|no derivatives", "(?:creative commons )?attribution non ?commercial no ?derivatives|attribution noncommercial noderivatives", None),
    ("cc-by-nc-sa", "sharealike|share alike", "(?:creative commons )?attribution non ?commercial share ?alike", None),
    ("cc-by-nc", "noncommercial|non commercial", "(?:creative commons )?attribution non ?commercial(?! (?:share|no))", None),
    ("cc-by-nd", "nd", "(?:cc|creative commons) by nd", "creativecommons org licenses by nd"),
    ("cc-by-nd", "noderivatives|no derivatives", "(?:creative commons )?attribution no ?derivatives", None),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa", "creativecommons org licenses by sa"),
    ("cc-by-sa", "sharealike|share alike", "(?:creative commons )?attribution share ?alike", None),
    ("cc-by", "cc", "cc by(?! (?:nc|nd|sa) )", "creativecommons org licenses by [0-9]"),
    ("cc-by", "attribution", "creative commons attribution(?! (?:non|no|share))", None),
    ("public-domain", "domain", "public domain", None),
    ("odbl", "odbl", "odbl", "opendatacommons org licenses odbl"),
    ("odbl", "database", "open (?:data commons )?database", None),
    ("odc-by", "commons", "open data commons attribution", "opendatacommons org licenses by"),
    ("pddl", "commons", "open data commons public domain dedication", None),
    ("ofl", "font", "(?:sil )?open font", "scripts sil org ofl"),
    ("ogl", "government", "open government", "nationalarchives gov uk doc open government licence"),
    ("eupl", "eupl", "eupl", None),
    ("eupl", "european", "european union public", None),
    ("cecill", "cecill", "cecill(?: [bc])?", "cecill info licences"),
    ("ms-pl", "microsoft", "microsoft public", "opensource org licenses ms pl"),
    ("ms-rl", "reciprocal", "microsoft reciprocal", None),
    ("python", "python|psf", "python software foundation|psf", "python org psf license"),
    ("php", "php", "php", "php net license"),
    ("ruby", "ruby", "ruby", None),
    ("openssl", "openssl", "openssl", "openssl org source license"),
    ("postgresql", "postgresql", "postgresql", "postgresql org about licence"),
    ("ncsa", "illinois", "(?:university of )?illinois(?: ncsa)?(?: open source)?", None),
    ("upl", "universal", "universal permissive", None),
    ("afl", "academic", "academic free", "opensource org licenses afl"),
    ("osl", "open", "open software", "opensource org licenses osl"),
    ("ecl", "educational", "educational community", None),
    ("vim", "vim", "vim", None),
    ("w3c", "w3c", "w3c(?: software)?", "w3 org consortium legal"),
    ("x11", "x11", "x11", None),
    ("sspl", "server", "server side public", "mongodb com licensing server side public license"),
    ("busl", "business", "business source", "mariadb com bsl11"),
    ("elastic", "elastic", "elastic", "elastic co licensing elastic license"),
    ("llama", "llama", "llama [0-9]+(?: community)?", None),
    ("rail", "rail|openrail", "(?:bigscience |creativeml )?open ?rail(?: m)?", None),
    ("polyform", "polyform", "polyform (?:noncommercial|strict|shield|perimeter|small business)", "polyformproject org licenses"),
    ("reserved", "reserved|tous droits|vorbehalten|reservados", "all rights reserved|tous droits r(?:e|\xc3[\xa9\x89])serv(?:e|\xc3[\xa9\x89])s|alle rechte vorbehalten|todos los derechos reservados", None),
    ("proprietary", "proprietary", "proprietary(?: and confidential)?", None),
)
#: label, keyword, phrase of the license's own text, as a pattern over words.
TEXTS = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "furnished", "permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd", "endorse", "may be used to endorse or promote products derived from this software"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"),
    ("apache", "distributed", "software distributed under the license is distributed on an as is basis"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify"),
    ("gpl", "merchantability", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify"),
    ("agpl", "network", "if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms"),
    ("mpl", "source", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying", "the accompanying program is provided under the terms of this"),
    ("cddl", "covered", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived", "waived all copyright and related or neighboring rights"),
    ("wtfpl", "want", "you just do what the fuck you want to"),
    ("cc-by", "attribution", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "contributions", "you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "transform", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("ofl", "font", "the font software may be sold as part of a larger software package"),
    ("artistic", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("python", "nonexclusive", "hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test"),
    ("php", "php", "products derived from this software may not be called php"),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("postgresql", "agreement", "without a written agreement is hereby granted provided that the above copyright notice"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ncsa", "deal", "to deal with the software without restriction"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("public-domain", "disclaims", "the authors? disclaims? copyright to this source code"),
    ("public-domain", "dedicated", "dedicated to the public domain"),
    ("proprietary", "confidential", "contains? (?:confidential and proprietary|proprietary and confidential) information"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|use|distribution) of this [a-z]+"),
    ("proprietary", "reproduced", "(?:may|no part of this [a-z]+ may) (?:not )?be reproduced (?:in any form |or transmitted )?without"),
    ("odbl", "database", "you are free to copy distribute and use the database"),
    ("llama", "materials", "use of the llama materials"),
)
#: Labels, by license and version where the text tells it, and wordings that only its texts, titles or notices have: titles first, then
#: grants, conditions and disclaimers.  A signature's keyword is its longest word.
SIGNATURES = {
    "apache": (
        "you must give any other recipients of the work or derivative works a copy of this license",
        "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "apache-1.0": ("this product includes software developed by the apache group for use in the apache http server project",),
    "apache-1.1": (
        "the apache software license version 1 1",
        "this product includes software developed by the apache software foundation",
        "the names apache and apache software foundation must not be used to endorse or promote products derived from this software",
    ),
    "apache-2.0": (
        "apache license version 2 0 january 2004",
        "licensed under the apache license version 2 0 the license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "if the work includes a notice text file as part of its distribution",
        "any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license",
        "unless required by applicable law or agreed to in writing licensor provides the work",
    ),
    "mit": (
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "mit-0": ("mit no attribution",),
    "bsd": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "this software is provided by the regents and contributors as is and any express or implied warranties",
        "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software",
    ),
    "bsd-3": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products",
    ),
    "bsd-4": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "isc": (
        "provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ),
    "hpnd": (
        "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted",
        "both that copyright notice and this permission notice appear in supporting documentation",
    ),
    "gpl": (
        "you should have received a copy of the gnu general public license along with this program",
        "this program comes with absolutely no warranty for details type show w",
        "this is free software and you are welcome to redistribute it under certain conditions",
    ),
    "gpl-1": ("gnu general public license version 1 february 1989",),
    "gpl-2": (
        "gnu general public license version 2 june 1991",
        "under the terms of the gnu general public license as published by the free software foundation either version 2",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium",
        "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program",
        "activities other than copying distribution and modification are not covered by this license they are outside its scope",
        "you are not required to accept this license since you have not signed it",
        "because the program is licensed free of charge there is no warranty for the program to the extent permitted by applicable law",
    ),
    "gpl-3": (
        "gnu general public license version 3 29 june 2007",
        "under the terms of the gnu general public license as published by the free software foundation either version 3",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
        "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement",
        "no covered work shall be deemed part of an effective technological measure under any applicable law",
        "you may convey verbatim copies of the program s source code as you receive it in any medium",
        "you may convey a covered work in object code form under the terms of sections 4 and 5",
        "each time you convey a covered work the recipient automatically receives a license from the original licensors",
    ),
    "lgpl": (
        "you should have received a copy of the gnu lesser general public license along with this",
        "this library is distributed in the hope that it will be useful but without any warranty",
        "a program that contains no derivative of any portion of the library but is designed to work with the library",
    ),
    "lgpl-2": (
        "gnu library general public license version 2 june 1991",
        "you should have received a copy of the gnu library general public license along with this",
    ),
    "lgpl-2.1": (
        "gnu lesser general public license version 2 1 february 1999",
        "this license the lesser general public license applies to some specially designated software packages",
    ),
    "lgpl-3": (
        "gnu lesser general public license version 3 29 june 2007",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
        "a combined work is a work produced by combining or linking an application with the library",
    ),
    "agpl-3": (
        "gnu affero general public license version 3 19 november 2007",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works",
        "you should have received a copy of the gnu affero general public license along with this program",
        "specifically designed to ensure cooperation with the community in the case of network server software",
        "an opportunity to receive the corresponding source of your version by providing access to the corresponding source from a network server at no charge",
    ),
    "gfdl": (
        "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom",
        "with no invariant sections no front cover texts and no back cover texts",
        "a transparent copy of the document means a machine readable copy",
    ),
    "gfdl-1.1": ("gnu free documentation license version 1 1 march 2000",),
    "gfdl-1.2": ("gnu free documentation license version 1 2 november 2002",),
    "gfdl-1.3": ("gnu free documentation license version 1 3 3 november 2008",),
    "mpl-1.1": (
        "the contents of this file are subject to the mozilla public license version 1 1",
        "the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims",
        "see the license for the specific language governing rights and limitations under the license",
    ),
    "mpl-2.0": (
        "subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is incompatible with secondary licenses as defined by the mozilla public license",
        "all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this license",
    ),
    "npl": ("the contents of this file are subject to the netscape public license",),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "the accompanying program is provided under the terms of this eclipse public license",
        "a contributor may choose to distribute the program in object code form under its own license agreement",
        "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    ),
    "cpl": ("the accompanying program is provided under the terms of this common public license",),
    "ipl": ("the accompanying program is provided under the terms of this ibm public license", "ibm public license version 1 0"),
    "cddl": (
        "when distributing covered code include this cddl header in each file",
        "you may obtain a copy of the license at usr src opensolaris license",
    ),
    "cddl-1.0": ("common development and distribution license cddl version 1 0",),
    "cddl-1.1": ("common development and distribution license cddl version 1 1",),
    "creative-commons": (
        "the licensor cannot revoke these freedoms as long as you follow the license terms",
        "you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits",
        "copy and redistribute the material in any medium or format",
        "the work as defined below is provided under the terms of this creative commons public license",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons",
    ),
    "cc-by-2.0": ("creative commons attribution 2 0 generic",),
    "cc-by-3.0": ("creative commons attribution 3 0 unported", "creative commons attribution 3 0 united states"),
    "cc-by-4.0": ("creative commons attribution 4 0 international",),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your contributions under the same license as the original",),
    "cc-by-sa-2.0": ("creative commons attribution sharealike 2 0 generic", "creative commons attribution share alike 2 0 generic"),
    "cc-by-sa-3.0": ("creative commons attribution sharealike 3 0 unported", "creative commons attribution share alike 3 0 unported"),
    "cc-by-sa-4.0": ("creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international"),
    "cc-by-nc-3.0": ("creative commons attribution noncommercial 3 0 unported", "creative commons attribution non commercial 3 0 unported"),
    "cc-by-nc-4.0": ("creative commons attribution noncommercial 4 0 international", "creative commons attribution non commercial 4 0 international"),
    "cc-by-nd-3.0": ("creative commons attribution noderivs 3 0 unported",),
    "cc-by-nd-4.0": ("creative commons attribution noderivatives 4 0 international", "creative commons attribution no derivatives 4 0 international"),
    "cc-by-nc-sa-3.0": ("creative commons attribution noncommercial sharealike 3 0 unported",),
    "cc-by-nc-sa-4.0": ("creative commons attribution noncommercial sharealike 4 0 international",),
    "cc-by-nc-nd-3.0": ("creative commons attribution noncommercial noderivs 3 0 unported",),
    "cc-by-nc-nd-4.0": ("creative commons attribution noncommercial noderivatives 4 0 international",),
    "cc0-1.0": (
        "cc0 1 0 universal",
        "the person who associated a work with this deed has dedicated the work to the public domain",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights",
    ),
    "public-domain": (
        "this file has been put into the public domain",
        "this work has been released into the public domain by its author",
        "is a work of the united states government and is not subject to copyright protection",
        "no copyright is claimed in the united states under title 17",
    ),
    "boost-1.0": (
        "boost software license version 1 0 august 17th 2003",
        "distributed under the boost software license version 1 0",
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    ),
    "zlib": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "this notice may not be removed or altered from any source distribution",
    ),
    "libpng": ("the png reference library is supplied as is", "the contributing authors and group 42 inc disclaim all warranties"),
    "unlicense": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    ),
    "wtfpl-2": (
        "do what the fuck you want to public license version 2 december 2004",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    ),
    "beerware": ("as long as you retain this notice you can do whatever you want with this stuff",),
    "ofl-1.1": (
        "sil open font license version 1 1 26 february 2007",
        "this font software is licensed under the sil open font license version 1 1",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        "no modified version of the font software may use the reserved font name",
    ),
    "artistic-1.0": (
        "you may otherwise modify your copy of this package in any way provided that you insert a prominent notice in each changed file",
        "you may charge a reasonable copying fee for any distribution of this package",
    ),
    "artistic-2.0": (
        "the artistic license 2 0",
        "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    ),
    "afl-3.0": ("licensed under the academic free license version 3 0", "this academic free license the license applies to any original work of authorship"),
    "osl-3.0": ("licensed under the open software license version 3 0", "this open software license the license applies to any original work of authorship"),
    "ecl-2.0": ("licensed under the educational community license version 2 0",),
    "ms-pl": ("this license governs use of the accompanying software if you use the software you accept this license",),
    "python": (
        "this license agreement is between the python software foundation psf and the individual or organization licensee",
        "psf is making python available to licensee on an as is basis",
        "licensee may not use psf trademarks or trade name in a trademark sense to endorse or promote products or services of licensee",
    ),
    "php": ("this product includes php software freely available from",),
    "php-3.01": ("the php license version 3 01",),
    "openssl": (
        "the names openssl toolkit and openssl project must not be used to endorse or promote products",
        "products derived from this software may not be called openssl nor may openssl appear in their names",
    ),
    "ssleay": ("this product includes cryptographic software written by eric young",),
    "postgresql": (
        "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages",
        "the university of california has no obligations to provide maintenance support updates enhancements or modifications",
    ),
    "x11": (
        "except as contained in this notice the name of the x consortium shall not be used in advertising",
        "in no event shall the x consortium be liable for any claim damages or other liability",
    ),
    "ncsa": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",),
    "w3c": (
        "w3c software notice and license",
        "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply",
    ),
    "odbl": (
        "is made available under the open database license",
        "any rights in individual contents of the database are licensed under the database contents license",
    ),
    "pddl": ("is made available under the public domain dedication and license",),
    "eupl": ("this european union public licence the eupl applies to the work",),
    "eupl-1.1": ("licensed under the eupl version 1 1",),
    "eupl-1.2": ("licensed under the eupl version 1 2",),
    "cecill": ("license under french law and abiding by the rules of distribution of free software",),
    "sspl-1": (
        "server side public license version 1 october 16 2018",
        "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available",
    ),
    "busl-1.1": (
        "business source license 1 1",
        "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
    ),
    "elastic-2.0": (
        "you may not provide the software to third parties as a hosted or managed service",
        "you may not move change disable or circumvent the license key functionality in the software",
    ),
    "llama-2": ("llama 2 community license agreement",),
    "llama-3": ("meta llama 3 community license agreement", "built with meta llama 3"),
    "llama": ("monthly active users of the products or services made available by or for licensee",),
    "rail": (
        "you agree not to use the model or derivatives of the model",
        "in any way that violates any applicable national federal state local or international law or regulation",
    ),
    "polyform": ("any noncommercial purpose is a permitted purpose",),
    "upl-1.0": ("the universal permissive license upl version 1 0",),
    "blueoak-1.0": (
        "blue oak model license version 1 0 0",
        "each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright in it",
    ),
    "mulan-2": ("mulan permissive software license version 2",),
    "ogl-3.0": ("contains public sector information licensed under the open government licence v3 0",),
    "freetype": ("portions of this software are copyright the freetype project",),
    "ijg": ("this software is based in part on the work of the independent jpeg group",),
    "unicode": ("to any person obtaining a copy of the unicode data files and any associated documentation",),
    "sleepycat": ("redistributions in any form must be accompanied by information on how to obtain complete source code for the db software",),
    "qpl-1.0": ("the q public license version 1 0",),
    "lppl": ("this work may be distributed and or modified under the conditions of the latex project public license", "this work has the lppl maintenance status"),
    "zpl-2.1": ("zope public license zpl version 2 1",),
    "apsl": ("that are subject to the apple public source license",),
    "proprietary": (
        "this software is the confidential and proprietary information of",
        "you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement",
        "the software is licensed not sold",
        "you may not reverse engineer decompile or disassemble the software",
        "use duplication or disclosure by the government is subject to restrictions",
        "this end user license agreement is a legal agreement between you and",
    ),
}
_LICENSE = "(?: licen[sc]es?)"
_NAMED = {"gpl", "lgpl", "agpl", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "public-domain", "reserved", "odbl", "wtfpl", "unlicense", "mpl", "cddl", "eupl", "proprietary"}
_VERSION = r"(?: (?:version|v|ver))?(?: v?(?P<version>[0-9](?: [0-9]{1,2})?))"
#: Kind of rule, priority (lower is first), and how sure a detection by it is.
KINDS = (("tag", 0, 0.98), ("notice", 2, 0.9), ("versioned", 3, 0.8), ("address", 4, 0.7), ("mention", 5, 0.4))
TEXT_PRIORITY, TEXT_SURE = 1, 0.95
#: Names that are common words too: a bare mention of them says nothing.
_COMMON = {"ruby", "x11", "vim", "elastic", "ncsa"}


@lru_cache(maxsize=1)
def rules() -> tuple[tuple[str, str, int, float, re.Pattern], ...]:
    """(label, keywords, priority, sureness, pattern), by priority, then in the order of the families."""
    out = []
    for label, keywords, name, address in FAMILIES:
        named, optional = f"(?:{name})", "?" if label in _NAMED else ""
        bodies = {
            "tag": f"spdx license identifier {named}(?: licen[sc]e)?(?:{_VERSION})?",
            "notice": rf"(?:licen[sc]ed|released|distributed|published|available|covered|provided|redistribute it)(?: [a-z0-9]+){{0,6}}? (?:under|by)(?: the| terms| conditions| of| a| an| version| following){{0,6}} {named}{_LICENSE}?(?:{_VERSION})?",
            "versioned": f"{named}{_LICENSE}{optional}{_VERSION}",
            "address": address,
            "mention": f"{named}{_LICENSE}{optional}",
        }
        for kind, priority, sure in KINDS:
            if bodies[kind] and not (kind == "mention" and label in _COMMON):
                out.append((label, address.split()[0] if kind == "address" else keywords, priority, sure, re.compile(f"(?<= )(?:{bodies[kind]})(?= )")))
    texts = [*TEXTS, *((label, max(phrase.split(), key=len), phrase) for label, own in SIGNATURES.items() for phrase in own)]
    out += [(label, keyword, TEXT_PRIORITY, TEXT_SURE, re.compile(f"(?<= )(?:{phrase})(?= )")) for label, keyword, phrase in texts]
    return tuple(sorted(out, key=lambda r: r[2]))


@lru_cache(maxsize=1)
def prefilter():
    """An automaton over the keywords; each gives the places of its rules."""
    import ahocorasick

    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r[1].split("|"):
            by.setdefault(k, []).append(i)
    out = ahocorasick.Automaton()
    for k, at in by.items():
        out.add_word(f" {k}" if len(k) > 3 else f" {k} ", tuple(at))
    out.make_automaton()
    return out


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> tuple[int, str]:
    """Number of words, and the words with a blank before, between and after them (bytes as Latin-1 characters)."""
    words = (text or "").encode().translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    return len(words), f" {b' '.join(words).decode('latin-1')} "


def word_starts(joined: str) -> np.ndarray:
    """Place of the blank before each word, and of the last blank."""
    return np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)


def base_places(joined: str, starts: np.ndarray | None = None) -> list[tuple[str, int]]:
    """(label, index of the first word) of each place of a base phrase."""
    starts = word_starts(joined) if starts is None else starts
    out = []
    for phrase, label in BASE_PHRASES:
        places = []
        at = joined.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            at = joined.find(f" {phrase} ", at + 1)
        out += [(label, i) for i in np.searchsorted(starts, places).tolist()]
    return out


class Reach:
    """Intervals; whether one of them holds another, by a tree of the furthest ends over the starts up to each place."""

    def __init__(self, starts: list[int]):
        self.at = {x: i + 1 for i, x in enumerate(sorted(set(starts)))}
        self.end = [0] * (len(self.at) + 1)

    def holds(self, a: int, b: int) -> bool:
        i = self.at[a]
        while i:
            if self.end[i] >= b:
                return True
            i &= i - 1
        return False

    def add(self, a: int, b: int) -> None:
        i = self.at[a]
        while i < len(self.end):
            self.end[i] = max(self.end[i], b)
            i += i & -i


def detect(joined: str, every: bool = False) -> list[tuple[str, int, int, float]]:
    """(label, first character, character after the last, sureness) of the detections that stay.

    every: all rules are tried, without the keywords; the result is the same.
    """
    tried = range(len(rules())) if every else sorted({i for _, at in prefilter().iter(joined) for i in at})
    found = []
    for i in tried:
        label, _, priority, sure, pattern = rules()[i]
        for m in pattern.finditer(joined):
            version = m.groupdict().get("version")
            found.append((priority, m.start() - m.end(), i, f"{label}-{version.replace(' ', '.')}" if version else label, m.start(), m.end(), sure))
    kept, reach = [], Reach([x[4] for x in found])
    for _, _, _, label, a, b, sure in sorted(found):
        if not reach.holds(a, b):
            kept.append((label, a, b, sure))
            reach.add(a, b)
    return kept


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``."""
    fields = {
        "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double",
        "detections": "array<struct<label:string,first_word:bigint,last_word:bigint,sure:double>>",
    }

    def work(texts: pa.Array) -> list:
        out = []
        for t in texts.to_pylist():
            n, joined = words_of(t)
            starts = word_starts(joined)
            base, found = base_places(joined, starts), detect(joined)
            doubt = 1.0
            for *_, sure in found:
                doubt *= 1 - sure
            if base and not found:
                doubt = 0.6
            at = [i for _, i in base]
            names = {label for label, _ in base}
            spans = [{"label": label, "first_word": int(np.searchsorted(starts, a)) - 1, "last_word": int(np.searchsorted(starts, b)) - 1, "sure": sure} for label, a, b, sure in found]
            out.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x[0] for x in found})), 1 - doubt, spans))
        return [[x[i] for x in out] for i in range(len(fields))]

    return append_columns(docs, text, fields, work)


def op10_license_rules(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text", "detections")
