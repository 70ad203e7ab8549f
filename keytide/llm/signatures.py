"""License signatures: hand-written patterns over lower-case words joined by single spaces, in order of priority.

A rule is (label, score, keyword, pattern) or (label, score, keyword, pattern, context). The keyword is a literal that every match
holds, inside it or in the context before it; the context is a pattern that has to stand directly before the match. LIC
stands for licen[sc]e and VER for an optional "version" or "v". Full grants and disclaimers come first, then
identifiers, versioned names, names, and wordings that name no license.
"""

from __future__ import annotations

import re

#: Place in an SPDX expression: after the identifier tag, or after an operator up to 80 characters on.
_SPDX = r"spdx LIC identifier (|[a-z0-9 ]{1,80} (or|and) )"
#: Place after wording that says that a license follows.
_UNDER = r"(under|is|the|by|via|using|of|to|with|and|or)( (the|an?))?( (terms|conditions|provisions))?( (of|and conditions of))?( the)? "
#: What stands before a short name that is a word of its own in other languages or contexts.
_LICENSED = r"(LICd|released|distributed|published|available|provided|offered|dual LICd|LIC|LICs) (under|as|is|with|by|via)( (the|an?))?( (terms|conditions))?( (of|and conditions of))?( the)? "

RULES: tuple[tuple, ...] = (
    # grants and disclaimers
    ("agpl-3.0", 0.98, "affero general public", r"under the terms of the gnu affero general public LIC as published by the free software foundation either version 3( of the LIC)?( or at your option any later version)?"),
    ("agpl-3.0", 0.97, "affero general public", r"gnu affero general public LIC version 3 19 november 2007"),
    ("lgpl-2.1", 0.98, "lesser general public", r"under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1( of the LIC)?( or at your option any later version)?"),
    ("lgpl-3.0", 0.98, "lesser general public", r"under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3( of the LIC)?( or at your option any later version)?"),
    ("lgpl-2.0", 0.98, "library general public", r"under the terms of the gnu library general public LIC as published by the free software foundation either version 2( of the LIC)?( or at your option any later version)?"),
    ("gpl-2.0", 0.98, "general public", r"under the terms of the gnu general public LIC as published by the free software foundation either version 2( of the LIC)?( or at your option any later version)?"),
    ("gpl-3.0", 0.98, "general public", r"under the terms of the gnu general public LIC as published by the free software foundation either version 3( of the LIC)?( or at your option any later version)?"),
    ("gpl-2.0", 0.97, "general public", r"under the terms of the gnu general public LIC version 2( only)?( as published by the free software foundation)?"),
    ("gpl-3.0", 0.97, "general public", r"under the terms of the gnu general public LIC version 3( only)?( as published by the free software foundation)?"),
    ("gpl-2.0", 0.97, "general public", r"gnu general public LIC version 2 june 1991"),
    ("gpl-3.0", 0.97, "general public", r"gnu general public LIC version 3 29 june 2007"),
    ("lgpl-2.1", 0.97, "lesser general public", r"gnu lesser general public LIC version 2 1 february 1999"),
    ("lgpl-3.0", 0.97, "lesser general public", r"gnu lesser general public LIC version 3 29 june 2007"),
    ("gpl", 0.9, "general public", r"you should have received a copy of the gnu general public LIC( along with (this|the) (program|software|library|file))?"),
    ("lgpl", 0.9, "lesser general public", r"you should have received a copy of the gnu lesser general public LIC( along with (this|the) (program|software|library|file))?"),
    ("agpl", 0.9, "affero general public", r"you should have received a copy of the gnu affero general public LIC( along with (this|the) (program|software|library|file))?"),
    ("gpl", 0.8, "free software you can redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public LIC"),
    ("lgpl", 0.8, "free software you can redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public LIC"),
    ("agpl", 0.8, "free software you can redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu affero general public LIC"),
    ("gfdl-1.3", 0.97, "free documentation", r"under the terms of the gnu free documentation LIC version 1 3( or any later version( published by the free software foundation)?)?"),
    ("gfdl-1.2", 0.97, "free documentation", r"under the terms of the gnu free documentation LIC version 1 2( or any later version( published by the free software foundation)?)?"),
    ("apache-2.0", 0.98, "apache", r"LICd under the apache LIC version 2 0 the LIC you may not use this file except in compliance with the LIC"),
    ("apache-2.0", 0.97, "apache", r"apache LIC version 2 0 january 2004"),
    ("apache-2.0", 0.95, "apache org licenses license 2 0", r"(https? )?(www )?apache org licenses license 2 0( txt| html)?"),
    ("apache-1.1", 0.95, "apache", r"the apache software LIC version 1 1"),
    ("apache-1.0", 0.95, "apache", r"the apache (software )?LIC version 1 0"),
    ("mit", 0.98, "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?( to deal in the software without restriction)?"),
    ("mit", 0.93, "permission is hereby granted free of charge", r"permission is hereby granted free of charge( to any person( obtaining a copy)?)?"),
    ("mit", 0.85, "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", 0.8, "without warranty of any kind express or implied", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", 0.97, "permission to use copy modify and or distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 0.95, "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", 0.95, "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software and its documentation for any purpose( and without fee)? is hereby granted"),
    ("mit-0", 0.95, "mit no attribution", r"mit no attribution( LIC)?"),
    ("bsd-4-clause", 0.96, "all advertising materials mentioning features", r"all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("bsd-3-clause", 0.96, "endorse or promote products derived", r"neither the names? of [a-z0-9 ]{1,60}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", 0.94, "endorse or promote products derived", r"may( not)? be used to endorse or promote products derived from this software without( specific)? prior written permission"),
    ("bsd", 0.95, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?"),
    ("bsd", 0.9, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms"),
    ("bsd", 0.85, "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice( this list of conditions and the following disclaimer)?"),
    ("bsd", 0.85, "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice( this list of conditions and the following disclaimer)?"),
    ("zlib", 0.96, "this software is provided as is without any express or implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 0.9, "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 0.97, "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.92, "free and unencumbered software", r"free and unencumbered software"),
    ("wtfpl", 0.97, "do what the fuck you want to", r"(you just )?do what the fuck you want to( public LIC)?"),
    ("cc0-1.0", 0.96, "cc0 1 0", r"cc0 1 0 universal( public domain dedication)?"),
    ("cc0-1.0", 0.95, "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero( 1 0)?"),
    ("cc0-1.0", 0.9, "waived all copyright", r"(has|have) waived all copyright and related or neighboring rights"),
    ("bsl-1.0", 0.96, "boost software", r"distributed under the boost software LIC version 1 0"),
    ("bsl-1.0", 0.95, "obtaining a copy of the software and accompanying documentation", r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("mpl-2.0", 0.98, "mozilla public", r"this source code form is subject to the terms of the mozilla public LIC v(ersion)? 2 0"),
    ("mpl-1.1", 0.97, "mozilla public", r"the contents of this file are subject to the mozilla public LIC version 1 1"),
    ("mpl-2.0", 0.95, "mozilla org mpl 2 0", r"mozilla org mpl 2 0"),
    ("epl-2.0", 0.97, "eclipse public", r"made available under the terms of the eclipse public LIC (v|version )?2 0"),
    ("epl-1.0", 0.97, "eclipse public", r"made available under the terms of the eclipse public LIC (v|version )?1 0"),
    ("cddl-1.0", 0.96, "common development and distribution", r"the contents of this file are subject to the terms of the common development and distribution LIC"),
    ("eupl-1.2", 0.96, "eupl", r"LICd under the eupl (VER)?1 2( or as soon they will be approved by the european commission)?"),
    ("artistic-2.0", 0.95, "artistic", r"under the terms of the artistic LIC (VER)?2 0"),
    ("psf-2.0", 0.95, "python software foundation", r"python software foundation LIC version 2"),
    ("ofl-1.1", 0.97, "sil open font", r"LICd under the sil open font LIC version 1 1"),
    ("odbl-1.0", 0.95, "open database", r"made available under the open database LIC"),
    ("odc-by-1.0", 0.95, "open data commons attribution", r"open data commons attribution LIC( v1 0)?"),
    ("pddl-1.0", 0.95, "public domain dedication and licen", r"(open data commons )?public domain dedication and LIC"),
    ("ncsa", 0.95, "illinois", r"university of illinois( ncsa)? open source LIC"),
    ("postgresql", 0.95, "postgresql", r"postgresql LIC"),
    ("ssl-openssl", 0.95, "openssl", r"this product includes software developed by the openssl project( for use in the openssl toolkit)?"),
    ("json", 0.95, "shall be used for good not evil", r"the software shall be used for good not evil"),
    ("beerware", 0.95, "you can buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer( in return)?"),
    ("ms-pl", 0.95, "microsoft public", r"microsoft public LIC"),
    ("ms-rl", 0.95, "microsoft reciprocal", r"microsoft reciprocal LIC"),
    ("busl-1.1", 0.95, "business source", r"business source LIC( (VER)?1 1)?"),
    ("sspl-1.0", 0.95, "server side public", r"server side public LIC( (VER)?1)?"),
    ("elastic-2.0", 0.95, "elastic licen", r"elastic LIC( (VER)?2 0)?"),
    # identifiers in SPDX expressions
    ("agpl-3.0", 1.0, "spdx", r"agpl 3 0( only| or later)?", _SPDX), ("agpl-1.0", 1.0, "spdx", r"agpl 1 0( only| or later)?", _SPDX),
    ("lgpl-2.0", 1.0, "spdx", r"lgpl 2 0( only| or later)?", _SPDX), ("lgpl-2.1", 1.0, "spdx", r"lgpl 2 1( only| or later)?", _SPDX), ("lgpl-3.0", 1.0, "spdx", r"lgpl 3 0( only| or later)?", _SPDX),
    ("gpl-1.0", 1.0, "spdx", r"gpl 1 0( only| or later)?", _SPDX), ("gpl-2.0", 1.0, "spdx", r"gpl 2 0( only| or later)?", _SPDX), ("gpl-3.0", 1.0, "spdx", r"gpl 3 0( only| or later)?", _SPDX),
    ("gfdl-1.1", 1.0, "spdx", r"gfdl 1 1( only| or later)?", _SPDX), ("gfdl-1.2", 1.0, "spdx", r"gfdl 1 2( only| or later)?", _SPDX), ("gfdl-1.3", 1.0, "spdx", r"gfdl 1 3( only| or later)?", _SPDX),
    ("apache-1.0", 1.0, "spdx", r"apache 1 0", _SPDX), ("apache-1.1", 1.0, "spdx", r"apache 1 1", _SPDX), ("apache-2.0", 1.0, "spdx", r"apache 2 0", _SPDX),
    ("mit-0", 1.0, "spdx", r"mit 0", _SPDX), ("mit-cmu", 1.0, "spdx", r"mit cmu", _SPDX), ("mit", 1.0, "spdx", r"mit", _SPDX),
    ("bsd-1-clause", 1.0, "spdx", r"bsd 1 clause", _SPDX), ("bsd-2-clause", 1.0, "spdx", r"bsd 2 clause( patent| views)?", _SPDX), ("bsd-3-clause", 1.0, "spdx", r"bsd 3 clause( clear| lbnl| attribution)?", _SPDX), ("bsd-4-clause", 1.0, "spdx", r"bsd 4 clause( uc)?", _SPDX),
    ("0bsd", 1.0, "spdx", r"0bsd", _SPDX), ("isc", 1.0, "spdx", r"isc", _SPDX), ("zlib", 1.0, "spdx", r"zlib( acknowledgement)?", _SPDX), ("unlicense", 1.0, "spdx", r"unlicense", _SPDX), ("wtfpl", 1.0, "spdx", r"wtfpl", _SPDX),
    ("mpl-1.0", 1.0, "spdx", r"mpl 1 0", _SPDX), ("mpl-1.1", 1.0, "spdx", r"mpl 1 1", _SPDX), ("mpl-2.0", 1.0, "spdx", r"mpl 2 0( no copyleft exception)?", _SPDX),
    ("epl-1.0", 1.0, "spdx", r"epl 1 0", _SPDX), ("epl-2.0", 1.0, "spdx", r"epl 2 0", _SPDX), ("cddl-1.0", 1.0, "spdx", r"cddl 1 0", _SPDX), ("cddl-1.1", 1.0, "spdx", r"cddl 1 1", _SPDX), ("cpl-1.0", 1.0, "spdx", r"cpl 1 0", _SPDX),
    ("eupl-1.1", 1.0, "spdx", r"eupl 1 1", _SPDX), ("eupl-1.2", 1.0, "spdx", r"eupl 1 2", _SPDX), ("bsl-1.0", 1.0, "spdx", r"bsl 1 0", _SPDX), ("artistic-1.0", 1.0, "spdx", r"artistic 1 0( perl| cl8)?", _SPDX), ("artistic-2.0", 1.0, "spdx", r"artistic 2 0", _SPDX),
    ("cc0-1.0", 1.0, "spdx", r"cc0 1 0", _SPDX), ("cc-by-nc-nd-4.0", 1.0, "spdx", r"cc by nc nd 4 0", _SPDX), ("cc-by-nc-sa-4.0", 1.0, "spdx", r"cc by nc sa 4 0", _SPDX), ("cc-by-nc-4.0", 1.0, "spdx", r"cc by nc 4 0", _SPDX),
    ("cc-by-nd-4.0", 1.0, "spdx", r"cc by nd 4 0", _SPDX), ("cc-by-sa-3.0", 1.0, "spdx", r"cc by sa 3 0", _SPDX), ("cc-by-sa-4.0", 1.0, "spdx", r"cc by sa 4 0", _SPDX), ("cc-by-3.0", 1.0, "spdx", r"cc by 3 0", _SPDX), ("cc-by-4.0", 1.0, "spdx", r"cc by 4 0", _SPDX),
    ("ofl-1.1", 1.0, "spdx", r"ofl 1 1", _SPDX), ("psf-2.0", 1.0, "spdx", r"(psf|python) 2 0", _SPDX), ("ncsa", 1.0, "spdx", r"ncsa", _SPDX), ("postgresql", 1.0, "spdx", r"postgresql", _SPDX), ("ms-pl", 1.0, "spdx", r"ms pl", _SPDX),
    ("upl-1.0", 1.0, "spdx", r"upl 1 0", _SPDX), ("vim", 1.0, "spdx", r"vim", _SPDX), ("w3c", 1.0, "spdx", r"w3c", _SPDX), ("x11", 1.0, "spdx", r"x11", _SPDX), ("odbl-1.0", 1.0, "spdx", r"odbl 1 0", _SPDX), ("blueoak-1.0.0", 1.0, "spdx", r"blueoak 1 0 0", _SPDX),
    # names with a version
    ("agpl-3.0", 0.9, "affero general public", r"(gnu )?affero general public LIC (VER)?3( 0)?( only| or( any)? later)?"),
    ("agpl-3.0", 0.85, "agpl", r"(gnu )?agpl (VER)?3( 0)?( only| or( any)? later)?"),
    ("agpl-3.0", 0.85, "agplv3", r"(gnu )?agplv3( 0)?( only| or( any)? later)?"),
    ("agpl-3.0", 0.8, "agpl3", r"agpl3( 0)?"),
    ("lgpl-2.0", 0.9, "library general public", r"(gnu )?library general public LIC (VER)?2( 0)?( only| or( any)? later)?"),
    ("lgpl-2.1", 0.9, "lesser general public", r"(gnu )?lesser general public LIC (VER)?2 1( only| or( any)? later)?"),
    ("lgpl-3.0", 0.9, "lesser general public", r"(gnu )?lesser general public LIC (VER)?3( 0)?( only| or( any)? later)?"),
    ("lgpl-2.1", 0.85, "lgpl", r"(gnu )?lgpl (VER)?2 1( only| or( any)? later)?"),
    ("lgpl-3.0", 0.85, "lgpl", r"(gnu )?lgpl (VER)?3( 0)?( only| or( any)? later)?"),
    ("lgpl-2.1", 0.85, "lgplv2", r"(gnu )?lgplv2 1( only| or( any)? later)?"),
    ("lgpl-2.0", 0.8, "lgplv2", r"(gnu )?lgplv2( 0)?( only| or( any)? later)?"),
    ("lgpl-3.0", 0.85, "lgplv3", r"(gnu )?lgplv3( 0)?( only| or( any)? later)?"),
    ("lgpl-2.1", 0.8, "lgpl2", r"lgpl2 1"), ("lgpl-3.0", 0.8, "lgpl3", r"lgpl3( 0)?"),
    ("gpl-1.0", 0.85, "general public", r"(gnu )?general public LIC (VER)?1( 0)?( only| or( any)? later)?"),
    ("gpl-2.0", 0.9, "general public", r"(gnu )?general public LIC (VER)?2( 0)?( only| or( any)? later)?"),
    ("gpl-3.0", 0.9, "general public", r"(gnu )?general public LIC (VER)?3( 0)?( only| or( any)? later)?"),
    ("gpl-2.0", 0.85, "gpl", r"(gnu )?gpl (VER)?2( 0)?( only| or( any)? later)?"),
    ("gpl-3.0", 0.85, "gpl", r"(gnu )?gpl (VER)?3( 0)?( only| or( any)? later)?"),
    ("gpl-2.0", 0.85, "gplv2", r"(gnu )?gplv2( 0)?( only| or( any)? later)?"),
    ("gpl-3.0", 0.85, "gplv3", r"(gnu )?gplv3( 0)?( only| or( any)? later)?"),
    ("gpl-2.0", 0.8, "gpl2", r"gpl2( 0)?"), ("gpl-3.0", 0.8, "gpl3", r"gpl3( 0)?"),
    ("gpl-2.0", 0.8, "general public", r"version 2( 0)? of the (gnu )?general public LIC"), ("gpl-3.0", 0.8, "general public", r"version 3( 0)? of the (gnu )?general public LIC"),
    ("gfdl-1.1", 0.85, "free documentation", r"(gnu )?free documentation LIC (VER)?1 1"), ("gfdl-1.2", 0.85, "free documentation", r"(gnu )?free documentation LIC (VER)?1 2"), ("gfdl-1.3", 0.85, "free documentation", r"(gnu )?free documentation LIC (VER)?1 3"),
    ("apache-2.0", 0.9, "apache", r"apache( software)? LIC (VER)?2( 0)?"),
    ("apache-2.0", 0.85, "apache", r"apache (VER)?2( 0)?( LIC)?", r"(under|LIC|LICs|LICd|or|and)( the)? "),
    ("apache-2.0", 0.85, "apache 2 0 licen", r"apache 2 0 LICd?"),
    ("apache-2.0", 0.8, "apache 2 licen", r"apache 2 LICd?"),
    ("apache-2.0", 0.75, "apache2", r"apache2( 0)?( LIC)?"),
    ("apache-1.1", 0.85, "apache", r"apache( software)? LIC (VER)?1 1"), ("apache-1.0", 0.85, "apache", r"apache( software)? LIC (VER)?1 0"),
    ("mpl-2.0", 0.9, "mozilla public", r"mozilla public LIC (VER)?2( 0)?"), ("mpl-1.1", 0.9, "mozilla public", r"mozilla public LIC (VER)?1 1"), ("mpl-1.0", 0.9, "mozilla public", r"mozilla public LIC (VER)?1 0"),
    ("mpl-2.0", 0.85, "mpl", r"mpl (VER)?2( 0)?"), ("mpl-1.1", 0.85, "mpl", r"mpl (VER)?1 1"), ("mpl-2.0", 0.85, "mplv2", r"mplv2( 0)?"), ("mpl-2.0", 0.8, "mpl2", r"mpl2( 0)?"),
    ("epl-2.0", 0.9, "eclipse public", r"eclipse public LIC (VER|v)?2( 0)?"), ("epl-1.0", 0.9, "eclipse public", r"eclipse public LIC (VER|v)?1( 0)?"), ("epl-2.0", 0.8, "epl 2 0", r"epl 2 0"), ("epl-1.0", 0.8, "epl 1 0", r"epl 1 0"),
    ("cddl-1.0", 0.9, "common development and distribution", r"common development and distribution LIC (VER)?1 0"), ("cddl-1.1", 0.9, "common development and distribution", r"common development and distribution LIC (VER)?1 1"), ("cddl-1.0", 0.85, "cddl", r"cddl (VER)?1 0"), ("cddl-1.1", 0.85, "cddl", r"cddl (VER)?1 1"),
    ("eupl-1.1", 0.9, "european union public", r"european union public LIC (VER)?1 1"), ("eupl-1.2", 0.9, "european union public", r"european union public LIC (VER)?1 2"), ("eupl-1.1", 0.85, "eupl", r"eupl (VER)?1 1"), ("eupl-1.2", 0.85, "eupl", r"eupl (VER)?1 2"),
    ("artistic-1.0", 0.85, "artistic", r"artistic LIC (VER)?1( 0)?"), ("artistic-2.0", 0.85, "artistic", r"artistic LIC (VER)?2( 0)?"),
    ("bsl-1.0", 0.85, "boost software", r"boost software LIC (VER)?1 0"), ("ofl-1.1", 0.85, "open font", r"(sil )?open font LIC (VER)?1 1"), ("osl-3.0", 0.85, "open software licen", r"open software LIC (VER)?3 0"), ("afl-3.0", 0.85, "academic free licen", r"academic free LIC (VER)?3 0"),
    ("cpl-1.0", 0.85, "common public licen", r"common public LIC( (VER)?1 0)?"), ("cecill-2.1", 0.85, "cecill", r"cecill( free software LIC( agreement)?)? (VER)?2 1"), ("cecill", 0.75, "cecill", r"cecill( [bc])?( LIC)?"),
    # names of clauses
    ("0bsd", 0.9, "bsd", r"((0|zero) clause bsd|bsd (0|zero) clause)( LIC)?"), ("0bsd", 0.85, "0bsd", r"0bsd( LIC)?"),
    ("bsd-2-clause", 0.9, "bsd", r"((2|two) clause bsd|bsd (2|two) clause)( LIC)?"), ("bsd-3-clause", 0.9, "bsd", r"((3|three) clause bsd|bsd (3|three) clause)( LIC)?"), ("bsd-4-clause", 0.9, "bsd", r"((4|four) clause bsd|bsd (4|four) clause)( LIC)?"),
    ("bsd-2-clause", 0.85, "bsd", r"(simplified|freebsd) bsd LIC"), ("bsd-2-clause", 0.8, "freebsd licen", r"freebsd LIC"), ("bsd-3-clause", 0.85, "bsd", r"(new|modified|revised) bsd( LIC)?"), ("bsd-4-clause", 0.85, "bsd", r"(original|old) bsd LIC"),
    # Creative Commons, the longest forms first
    ("cc-by-nc-nd", 0.9, "creative commons attribution non", r"creative commons attribution non ?commercial no ?deriv(ative|ative work)?s?( LIC)?( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc-nd", 0.9, "creative commons attribution noncommercial no", r"creative commons attribution noncommercial no ?deriv(ative|ative work)?s?( LIC)?( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc-sa", 0.9, "creative commons attribution non", r"creative commons attribution non ?commercial share ?alike( LIC)?( [1-4] [05])?( international| unported)?"),
    ("cc-by-nc", 0.9, "creative commons attribution non", r"creative commons attribution non ?commercial( LIC)?( [1-4] [05])?( international| unported)?( LIC)?"),
    ("cc-by-nd", 0.9, "creative commons attribution no", r"creative commons attribution no ?deriv(ative|ative work)?s?( LIC)?( [1-4] [05])?( international| unported)?"),
    ("cc-by-sa", 0.9, "creative commons attribution share", r"creative commons attribution share ?alike( LIC)?( [1-4] [05])?( international| unported)?( LIC)?"),
    ("cc-by", 0.9, "creative commons attribution", r"creative commons attribution( LIC)?( [1-4] [05])?( international| unported)?( LIC)?"),
    ("cc-by-nc-nd", 0.9, "cc by", r"cc by nc nd( [1-4] [05])?"), ("cc-by-nc-sa", 0.9, "cc by", r"cc by nc sa( [1-4] [05])?"), ("cc-by-nc", 0.9, "cc by", r"cc by nc( [1-4] [05])?"), ("cc-by-nd", 0.9, "cc by", r"cc by nd( [1-4] [05])?"), ("cc-by-sa", 0.9, "cc by", r"cc by sa( [1-4] [05])?"),
    ("cc-by", 0.85, "cc by", r"cc by [1-4] [05]"), ("cc-by", 0.75, "cc by", r"cc by( LIC)?", _UNDER),
    ("cc-by-nc-nd", 0.9, "creativecommons org licenses", r"creativecommons org licenses by nc nd( [1-4] [05])?"), ("cc-by-nc-sa", 0.9, "creativecommons org licenses", r"creativecommons org licenses by nc sa( [1-4] [05])?"), ("cc-by-nc", 0.9, "creativecommons org licenses", r"creativecommons org licenses by nc( [1-4] [05])?"),
    ("cc-by-nd", 0.9, "creativecommons org licenses", r"creativecommons org licenses by nd( [1-4] [05])?"), ("cc-by-sa", 0.9, "creativecommons org licenses", r"creativecommons org licenses by sa( [1-4] [05])?"), ("cc-by", 0.9, "creativecommons org licenses", r"creativecommons org licenses by( [1-4] [05])?"),
    ("cc0-1.0", 0.85, "cc0", r"cc0( 1 0)?( LIC)?"), ("cc0-1.0", 0.85, "creative commons zero", r"creative commons zero( v1 0| 1 0)?( universal)?( LIC)?"), ("cc", 0.6, "creative commons licen", r"creative commons LICd?"),
    # names without a version
    ("agpl", 0.8, "affero general public", r"(gnu )?affero general public LIC"), ("agpl", 0.7, "agpl", r"(gnu )?agpl( LIC)?"),
    ("lgpl", 0.8, "lesser general public", r"(gnu )?lesser general public LIC"), ("lgpl", 0.8, "library general public", r"(gnu )?library general public LIC"), ("lgpl", 0.7, "lgpl", r"(gnu )?lgpl( LIC)?"),
    ("gpl", 0.8, "general public", r"(gnu )?general public LIC"), ("gpl", 0.7, "gpl", r"(gnu )?gpl( LIC)?"), ("gfdl", 0.8, "free documentation", r"(gnu )?free documentation LIC"),
    ("apache", 0.75, "apache", r"apache( software)? LICd?"), ("mit", 0.85, "mit licen", r"mit LICd?"), ("mit", 0.8, "expat licen", r"expat LIC"), ("x11", 0.8, "x11 licen", r"x11 LIC"), ("mit", 0.75, " mit ", r"mit( LIC)?", _LICENSED), ("mit", 0.75, " mit ", r"mit", r"LIC (is |type |name )?"),
    ("bsd", 0.75, "bsd", r"bsd( style)? LICd?"), ("bsd", 0.7, " bsd ", r"bsd", _LICENSED), ("isc", 0.8, "isc licen", r"isc LICd?"), ("isc", 0.75, " isc ", r"isc", _LICENSED), ("zlib", 0.8, "zlib", r"zlib( libpng)? LIC"), ("zlib", 0.7, " zlib ", r"zlib", _LICENSED),
    ("mpl", 0.75, "mozilla public", r"mozilla public LIC"), ("mpl", 0.7, " mpl ", r"mpl", _LICENSED), ("epl", 0.75, "eclipse public", r"eclipse public LIC"), ("cddl", 0.75, "common development and distribution", r"common development and distribution LIC"), ("cddl", 0.7, "cddl", r"cddl"),
    ("eupl", 0.75, "european union public", r"european union public LIC"), ("eupl", 0.7, "eupl", r"eupl"), ("artistic", 0.75, "artistic", r"artistic LIC"), ("bsl-1.0", 0.75, "boost", r"boost( software)? LIC"), ("ofl", 0.75, "open font", r"(sil )?open font LIC"),
    ("unlicense", 0.85, "unlicense", r"(the )?unlicense"), ("wtfpl", 0.85, "wtfpl", r"wtfpl"), ("psf", 0.75, "python", r"python( software foundation)? LIC"), ("psf", 0.75, "psf", r"psf LIC"), ("odbl", 0.75, "open database", r"open database LIC"), ("odbl", 0.75, "odbl", r"odbl"),
    ("ruby", 0.75, "ruby", r"ruby LIC"), ("php", 0.75, "php", r"php LIC( (VER)?3 01)?"), ("vim", 0.75, "vim", r"vim LIC"), ("w3c", 0.75, "w3c", r"w3c( software)?( notice and)? LIC"), ("ncsa", 0.75, "ncsa", r"ncsa( open source)? LIC"), ("openssl", 0.75, "openssl", r"openssl LIC"),
    ("upl-1.0", 0.75, "universal permissive", r"universal permissive LIC( (VER)?1 0)?"), ("osl", 0.7, "open software licen", r"open software LIC"), ("afl", 0.7, "academic free licen", r"academic free LIC"), ("lppl", 0.75, "project public licen", r"latex project public LIC( (VER)?1 3c?)?"), ("qpl", 0.75, "q public licen", r"q public LIC( (VER)?1 0)?"),
    ("ipl", 0.75, "ibm public licen", r"ibm public LIC"), ("npl", 0.75, "netscape public licen", r"netscape public LIC"), ("apsl", 0.75, "apple public source", r"apple public source LIC"), ("etalab", 0.75, "licence ouverte", r"licence ouverte( open licence)?( (VER)?2 0)?"), ("ogl", 0.75, "open government", r"open government LIC( (VER|v)?[1-3]( 0)?)?"),
    ("llama", 0.75, "llama", r"llama( [23])?( [0-9])? community LIC( agreement)?"), ("openrail", 0.75, "openrail", r"(creativeml |bigscience )?openrail( m)?( LIC)?"), ("bigscience-rail", 0.75, "responsible ai licen", r"responsible ai LICs?"),
    # wordings
    ("public-domain", 0.8, "public domain", r"(released|dedicated|placed|put) (in|into|to) the public domain"), ("public-domain", 0.6, "public domain", r"(is|are) in the public domain"), ("public-domain", 0.7, "no copyright", r"no copyright (is )?claimed"),
    ("proprietary", 0.7, "all rights reserved", r"all rights reserved( unauthorized| no part)?"), ("proprietary", 0.7, "proprietary and confidential", r"proprietary and confidential"), ("proprietary", 0.7, "unauthorized copying", r"unauthorized copying( of this file)?( via any medium)? is (strictly )?prohibited"),
    ("proprietary", 0.6, "no part of this publication", r"no part of this publication may be reproduced"), ("non-commercial", 0.6, "non commercial use only", r"for non commercial use only"), ("non-commercial", 0.6, "noncommercial use only", r"for noncommercial use only"), ("research-only", 0.6, "purposes only", r"for (academic|research)( and (academic|research))? purposes only"),
    ("copyleft", 0.5, "copyleft", r"copyleft( LIC)?"), ("free-software", 0.4, "free software licen", r"free software LIC"), ("open-source", 0.4, "open source licen", r"open source LIC"),
)

#: A rule whose pattern can't do without LIC is gated by licen; the others by the first of these that their keyword holds.
GATES = (
    "spdx", "gpl", "copyright", "copyleft", "creative", "apache", "mpl", "bsd", "wtfpl", "cc0", "permission", "redistribut", "unencumbered", "domain", "eupl", "cddl", "mozilla", "obtaining a copy", "warranty", "altered", "fuck",
    "openssl", "shall be used for good", "buy me a beer", "cecill", "advertising", "endorse", "odbl", "epl 1 0", "epl 2 0", "openrail", "reserved", "proprietary", "unauthorized", "no part of this publication", "use only", "purposes only", "cc by", "no attribution", "licen",
)
#: Short names that are words of other languages too count only after such wording, one of which their context holds.
VERBS = ("licen", "released", "distributed", "published", "available", "provided", "offered")


def needed(pattern: str) -> str:
    """What is left of a pattern without its optional groups and its alternatives."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\([^()]*\)\?", "", pattern)
    while before != pattern or "(" in pattern:
        before, pattern = pattern, re.sub(r"\([^()]*\)", "", pattern)
    return pattern


def gates(rule: tuple) -> tuple[str, ...]:
    """Literals of which the words of a text hold at least one where the rule matches."""
    if len(rule) > 4 and rule[4] == _LICENSED:
        return VERBS
    if "LIC" in needed(rule[3]) or (len(rule) > 4 and "LIC" in needed(rule[4])):
        return ("licen",)
    return (next(g for g in GATES if g in rule[2]),)


def expanded(pattern: str) -> str:
    """The pattern with its abbreviations written out and no group that captures."""
    full = pattern.replace("LIC", "licen[sc]e").replace("(VER)?", "(version |v ?)?").replace("(VER|v)?", "(version |v ?)?")
    return re.sub(r"\((?!\?)", "(?:", full)
