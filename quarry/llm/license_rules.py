"""Signature rules of the licence scan: hand-written, ordered by priority.

A rule is (priority, label, keyword, pattern).  Priority 1 is strongest: full
notices and tags; 2: names with a version; 3: names; 4: hints.  A pattern is a
Java regular expression over lower-cased words with one space between them
(words are ASCII letters and digits and all characters above ASCII; marks such
as ``-``, ``.`` and ``/`` separate words, so "2.0" is "2 0").  It must match
whole words, and neither cross nor end in a space.  A rule is tried only on
texts that hold its keyword; every match of its pattern holds the keyword.
"""

from __future__ import annotations

#: Confidence of a detection by priority.
CONFIDENCE = {1: 0.95, 2: 0.85, 3: 0.6, 4: 0.3}

RULES = [
    # MIT and relatives
    (1, "mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?"),
    (1, "mit", "spdx license", r"spdx license identifier mit"),
    (1, "mit", "mit licen", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit license"),
    (1, "mit", "mit licen", r"(?:subject to|covered by|governed by) (?:the )?(?:terms of (?:the )?)?mit license"),
    (2, "mit", "opensource", r"opensource org licenses mit(?: license)?(?: php| html)?"),
    (2, "mit", "mit licen", r"mit license (?:see|file|text|terms|agreement)"),
    (3, "mit", "mit licen", r"mit licen[cs]ed?"),
    (3, "mit", "expat", r"expat licen[cs]e"),
    (2, "mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    (2, "mit-0", "mit 0", r"mit 0(?: licen[cs]e)?"),
    (1, "mit-0", "spdx license", r"spdx license identifier mit 0"),
    (2, "x11", "x11", r"(?:mit )?x11 (?:style )?licen[cs]e"),
    (3, "x11", "x consortium", r"x consortium licen[cs]e"),
    (1, "mit", "merge", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell(?: copies of the software)?"),
    (4, "warranty-disclaimer", "warranty", r"the software is provided as is without warranty of any kind"),
    # Apache
    (1, "apache-2.0", "apache", r"licensed under the apache license version 2 0"),
    (1, "apache-2.0", "apache", r"spdx license identifier apache 2 0"),
    (1, "apache-2.0", "apache", r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?license(?: version)?(?: v)? ?2(?: 0)?"),
    (1, "apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    (2, "apache-2.0", "apache", r"(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    (2, "apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    (2, "apache-2.0", "apache", r"apache 2 0 licen[cs]ed?"),
    (2, "apache-2.0", "asl", r"asl 2 0"),
    (2, "apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    (2, "apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v )?1 0"),
    (3, "apache", "apache", r"apache (?:software )?licen[cs]ed?"),
    (1, "apache", "apache", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache license"),
    (4, "apache", "apache", r"apache software foundation"),
    # GPL
    (1, "gpl-3.0", "gpl", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    (1, "gpl-2.0", "gpl", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    (1, "gpl-1.0", "gpl", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    (1, "gpl", "general public", r"free software you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?"),
    (1, "gpl-3.0", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public license(?: gpl)? (?:version |v )?3(?: 0)?"),
    (1, "gpl-2.0", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public license(?: gpl)? (?:version |v )?2(?: 0)?"),
    (1, "gpl", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu general public license"),
    (2, "gpl-3.0", "general public", r"(?:gnu )?general public license(?: gpl)? (?:version |v )?3(?: 0)?"),
    (2, "gpl-2.0", "general public", r"(?:gnu )?general public license(?: gpl)? (?:version |v )?2(?: 0)?"),
    (2, "gpl-1.0", "general public", r"(?:gnu )?general public license(?: gpl)? (?:version |v )?1(?: 0)?"),
    (2, "gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v )?3(?: 0)?(?: only| or later)?"),
    (2, "gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v )?2(?: 0)?(?: only| or later)?"),
    (2, "gpl-3.0", "gplv3", r"gplv3(?: or later| only)?"),
    (2, "gpl-2.0", "gplv2", r"gplv2(?: or later| only)?"),
    (2, "gpl", "gnu org", r"(?:www )?gnu org licenses gpl(?: [123] 0)?(?: txt| html)?"),
    (2, "gpl-2.0-classpath", "classpath", r"gpl(?: 2 0)? with classpath exception"),
    (2, "gpl-2.0-classpath", "classpath", r"classpath exception(?: 2 0)?"),
    (2, "gpl-2.0-linux-syscall", "syscall", r"linux syscall note"),
    (2, "gpl-gcc-exception", "gcc", r"gcc runtime library exception"),
    (2, "gpl-autoconf-exception", "autoconf", r"autoconf (?:configure script )?exception"),
    (2, "gpl-bison-exception", "bison", r"bison (?:parser )?exception"),
    (2, "gpl-font-exception", "font", r"gpl font exception"),
    (3, "gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    (3, "gpl", "gpl", r"(?:gnu )?gpl licen[cs]ed?"),
    (4, "gpl", "free software", r"free software foundation"),
    (4, "copyleft", "copyleft", r"copyleft(?: licen[cs]e)?"),
    # LGPL, AGPL, GFDL
    (1, "lgpl-3.0", "lgpl", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    (1, "lgpl-2.1", "lgpl", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    (1, "lgpl-2.0", "lgpl", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    (1, "lgpl", "general public", r"under the terms of the gnu (?:lesser|library) general public license"),
    (1, "lgpl", "general public", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:gnu )?(?:lesser|library) general public license"),
    (2, "lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)? (?:version |v )?3(?: 0)?"),
    (2, "lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)? (?:version |v )?2 1"),
    (2, "lgpl-2.0", "library general", r"(?:gnu )?library general public license(?: lgpl)? (?:version |v )?2(?: 0)?"),
    (2, "lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    (2, "lgpl-3.0", "lgpl", r"lgpl ?(?:version |v )?3(?: 0)?"),
    (2, "lgpl-2.1", "lgpl", r"lgpl ?(?:version |v )?2 1"),
    (2, "lgpl-2.0", "lgpl", r"lgpl ?(?:version |v )?2(?: 0)?"),
    (3, "lgpl", "lgpl", r"lgpl(?:v[23])?(?: licen[cs]ed?)?"),
    (1, "agpl-3.0", "agpl", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    (1, "agpl-3.0", "affero", r"under the terms of the gnu affero general public license"),
    (1, "agpl-3.0", "affero", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?affero general public license"),
    (2, "agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: agpl)? (?:version |v )?3(?: 0)?"),
    (2, "agpl-1.0", "affero", r"affero general public license (?:version |v )?1(?: 0)?"),
    (2, "agpl", "affero", r"(?:gnu )?affero (?:general public licen[cs]e|gpl)"),
    (3, "agpl", "agpl", r"agpl(?:v3)?(?: 3 0)?(?: licen[cs]ed?)?"),
    (1, "gfdl-1.3", "gfdl", r"spdx license identifier gfdl 1 3(?: only| or later)?"),
    (1, "gfdl-1.2", "gfdl", r"spdx license identifier gfdl 1 2(?: only| or later)?"),
    (2, "gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    (3, "gfdl", "gfdl", r"gfdl(?: 1 [123])?"),
    # BSD family
    (1, "bsd-3-clause", "bsd", r"spdx license identifier bsd 3 clause"),
    (1, "bsd-2-clause", "bsd", r"spdx license identifier bsd 2 clause"),
    (1, "bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    (1, "bsd", "bsd", r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)? license"),
    (1, "bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    (1, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (2, "bsd-2-clause", "bsd", r"(?:simplified bsd|bsd simplified|bsd 2 clause|two clause bsd|2 clause bsd)(?: licen[cs]e)"),
    (2, "bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    (2, "bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|three clause bsd|3 clause bsd)(?: licen[cs]e)?"),
    (2, "bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|four clause bsd|4 clause bsd)(?: licen[cs]e)?"),
    (2, "bsd-2-clause", "bsd", r"bsd 2 clause"),
    (2, "0bsd", "0bsd", r"0bsd(?: licen[cs]e)?"),
    (2, "0bsd", "zero clause", r"zero clause bsd(?: licen[cs]e)?"),
    (2, "bsd-1-clause", "bsd", r"bsd 1 clause(?: licen[cs]e)?"),
    (2, "bsd-patent", "bsd", r"bsd (?:2 clause )?plus patent(?: licen[cs]e)?"),
    (2, "bsd-3-clause-clear", "clear bsd", r"clear bsd licen[cs]e"),
    (2, "bsd", "opensource org", r"opensource org licenses bsd (?:license|[23] clause)"),
    (3, "bsd", "bsd", r"bsd(?: style| type| like)? licen[cs]ed?"),
    (4, "bsd", "regents", r"regents of the university of california"),
    # Permissive others
    (1, "isc", "isc", r"spdx license identifier isc"),
    (1, "isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (2, "isc", "isc", r"isc licen[cs]e"),
    (2, "isc", "internet systems", r"internet systems consortium licen[cs]e"),
    (1, "zlib", "zlib", r"spdx license identifier zlib"),
    (1, "zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    (1, "zlib", "altered", r"altered source versions must be plainly marked as such"),
    (2, "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    (2, "libpng", "libpng", r"libpng licen[cs]e(?: version 2)?"),
    (1, "boost-1.0", "bsl", r"spdx license identifier bsl 1 0"),
    (1, "boost-1.0", "boost", r"(?:distributed|licensed) under the boost software license version 1 0"),
    (2, "boost-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: v)?(?: 1 0)?"),
    (2, "boost-1.0", "boost org", r"boost org license 1 0 txt"),
    (1, "unlicense", "unlicense", r"spdx license identifier unlicense"),
    (1, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (2, "unlicense", "unlicense", r"(?:the )?unlicense(?: org)?"),
    (1, "wtfpl", "wtfpl", r"spdx license identifier wtfpl"),
    (2, "wtfpl", "wtfpl", r"wtfpl(?: version 2| v2)?"),
    (2, "wtfpl", "want to", r"do what the f[a-z]+ you want to public licen[cs]e(?: version 2)?"),
    (2, "postgresql", "postgresql", r"postgresql licen[cs]e"),
    (2, "python-2.0", "python", r"python (?:software foundation )?licen[cs]e(?: version 2| agreement)?"),
    (2, "python-2.0", "psf", r"psf licen[cs]e(?: agreement)?(?: version 2)?"),
    (2, "php-3.01", "php", r"php licen[cs]e version 3 01"),
    (2, "php-3.0", "php", r"php licen[cs]e(?: version 3(?: 0)?)?"),
    (2, "ruby", "ruby", r"ruby s? ?licen[cs]e"),
    (2, "artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    (2, "artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v )?1(?: 0)?"),
    (3, "artistic", "artistic", r"artistic licen[cs]e"),
    (3, "artistic", "perl", r"same terms as perl(?: itself)?"),
    (2, "openssl", "openssl", r"openssl licen[cs]e"),
    (2, "ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e"),
    (2, "curl", "curl", r"curl licen[cs]e"),
    (2, "tcl", "tcl", r"tcl tk licen[cs]e"),
    (2, "ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    (2, "ncsa", "illinois", r"university of illinois open source licen[cs]e"),
    (2, "w3c", "w3c", r"w3c (?:software (?:notice and )?)?licen[cs]e"),
    (2, "ijg", "independent jpeg", r"independent jpeg group(?: s)? licen[cs]e"),
    (2, "ijg", "independent jpeg", r"based in part on the work of the independent jpeg group"),
    (2, "icu", "icu", r"icu licen[cs]e"),
    (2, "unicode", "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    (2, "freetype", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e"),
    (2, "imagemagick", "imagemagick", r"imagemagick licen[cs]e"),
    (2, "vim", "vim", r"vim licen[cs]e"),
    (2, "beerware", "beer", r"beer ?ware licen[cs]e"),
    (2, "beerware", "beer", r"you can buy me a beer in return"),
    (2, "json", "good", r"shall be used for good not evil"),
    (2, "upl-1.0", "universal", r"universal permissive licen[cs]e(?: version)?(?: v)?(?: 1 0)?"),
    (2, "afl-3.0", "academic", r"academic free licen[cs]e(?: version| v)?(?: [123] [012])?"),
    (2, "ecl-2.0", "educational", r"educational community licen[cs]e(?: version)?(?: 2 0)?"),
    (2, "bluebox", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    (2, "mulan-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: v2| version 2)?"),
    (2, "ms-pl", "microsoft", r"microsoft public licen[cs]e(?: ms pl)?"),
    (2, "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    (2, "hpnd", "historical", r"historical permission notice and disclaimer"),
    (2, "naumen", "naumen", r"naumen public licen[cs]e"),
    (2, "zpl-2.1", "zope", r"zope public licen[cs]e(?: zpl)?(?: version 2 [01])?"),
    (2, "sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    (2, "intel", "intel", r"intel (?:open source|simplified software) licen[cs]e"),
    (2, "eiffel", "eiffel", r"eiffel forum licen[cs]e(?: version 2)?"),
    (2, "fair", "fair", r"fair licen[cs]e(?: fair)?"),
    (2, "xfree86", "xfree86", r"xfree86 licen[cs]e(?: 1 [01])?"),
    (2, "condor", "condor", r"condor public licen[cs]e"),
    (2, "entessa", "entessa", r"entessa public licen[cs]e"),
    # Weak copyleft and vendor licences
    (1, "mpl-2.0", "mpl", r"spdx license identifier mpl 2 0"),
    (1, "mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    (1, "mpl-1.1", "mozilla", r"subject to the mozilla public license version 1 1"),
    (2, "mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    (2, "mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1"),
    (2, "mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 0"),
    (2, "mpl-2.0", "mozilla org", r"(?:www )?mozilla org mpl 2 0"),
    (3, "mpl", "mozilla", r"mozilla public licen[cs]e"),
    (3, "mpl", "mpl", r"mpl (?:2 0|1 [01])"),
    (1, "epl-2.0", "epl", r"spdx license identifier epl 2 0"),
    (1, "epl-1.0", "epl", r"spdx license identifier epl 1 0"),
    (2, "epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    (2, "epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    (2, "edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: v)?(?: 1 0)?"),
    (3, "epl", "eclipse", r"eclipse public licen[cs]e"),
    (2, "cddl-1.1", "common development", r"common development and distribution licen[cs]e(?: cddl)? (?:version |v )?1 1"),
    (2, "cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: cddl)? (?:version |v )?1 0"),
    (3, "cddl", "common development", r"common development and distribution licen[cs]e"),
    (3, "cddl", "cddl", r"cddl(?: licen[cs]e)?(?: version)?(?: 1 [01])?"),
    (2, "cpl-1.0", "common public", r"common public licen[cs]e(?: version)?(?: v)?(?: 1 0)?"),
    (2, "cpal-1.0", "attribution", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?"),
    (2, "ipl-1.0", "ibm", r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    (2, "apsl-2.0", "apple", r"apple public source licen[cs]e(?: version)?(?: [12] [0-2])?"),
    (2, "nokia", "nokia", r"nokia open source licen[cs]e"),
    (2, "rpl-1.5", "reciprocal", r"reciprocal public licen[cs]e(?: 1 [15])?"),
    (2, "osl-3.0", "open software", r"open software licen[cs]e(?: version| v)?(?: [123] [01])?"),
    (2, "eupl-1.2", "european", r"european union public licen[cs]e(?: version)?(?: v)?(?: 1 2)?"),
    (2, "eupl", "eupl", r"eupl(?: v)?(?: 1 [012])?"),
    (2, "cecill-2.1", "cecill", r"cecill(?: b| c)?(?: free software licen[cs]e agreement| licen[cs]e)?(?: version 2(?: [01])?)?"),
    (2, "sleepycat", "sleepycat", r"sleepycat(?: public)? licen[cs]e"),
    (2, "qpl-1.0", "q public", r"q public licen[cs]e(?: version 1 0)?"),
    (2, "lppl-1.3", "latex", r"latex project public licen[cs]e(?: version)?(?: 1 [0-3])?"),
    (2, "npl-1.1", "netscape", r"netscape public licen[cs]e(?: version)?(?: 1 [01])?"),
    (2, "spl-1.0", "sun public", r"sun public licen[cs]e(?: version)?(?: 1 0)?"),
    (2, "motosoto", "motosoto", r"motosoto open source licen[cs]e"),
    (2, "sspl-1.0", "server side", r"server side public licen[cs]e(?: version)?(?: 1)?"),
    (2, "busl-1.1", "business source", r"business source licen[cs]e(?: version)?(?: 1 1)?"),
    (2, "elastic-2.0", "elastic", r"elastic licen[cs]e(?: version)?(?: v)?(?: 2(?: 0)?)?"),
    (2, "commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?"),
    (2, "polyform", "polyform", r"polyform (?:noncommercial|small business|perimeter|shield|strict) licen[cs]e(?: 1 0 0)?"),
    (2, "jrl", "java research", r"java research licen[cs]e"),
    (2, "bcl", "binary code", r"(?:oracle |sun )?binary code licen[cs]e(?: agreement)?"),
    # Creative Commons and data
    (1, "cc0-1.0", "cc0", r"spdx license identifier cc0 1 0"),
    (2, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?"),
    (2, "cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    (1, "cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (1, "cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (1, "cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (1, "cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (1, "cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (2, "cc-by", "creative commons", r"creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"),
    (1, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1-4] 0)?"),
    (1, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1-4] 0)?"),
    (1, "cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1-4] 0)?"),
    (1, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1-4] 0)?"),
    (1, "cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1-4] 0)?"),
    (1, "cc-by", "creativecommons", r"creativecommons org licenses by(?: [1-4] 0)?"),
    (2, "cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    (2, "cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    (2, "cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    (2, "cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    (2, "cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    (3, "cc-by", "cc by", r"cc by(?: [1-4] 0)?"),
    (3, "creative-commons", "creative commons", r"creative commons(?: licen[cs]ed?)?"),
    (2, "odbl-1.0", "open database", r"open database licen[cs]e(?: odbl)?(?: v)?(?: 1 0)?"),
    (2, "odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v)?(?: 1 0)?"),
    (2, "pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e(?: 1 0)?"),
    (2, "cdla-permissive", "community data", r"community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?"),
    (2, "cdla-sharing", "community data", r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?"),
    (2, "ogl-3.0", "open government", r"open government licen[cs]e(?: v)?(?: [123] 0)?"),
    (2, "ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: version)?(?: v)?(?: 1 [01])?"),
    (2, "ofl-1.1", "ofl", r"ofl 1 1"),
    # Models
    (2, "openrail", "openrail", r"(?:creativeml |bigcode |bigscience )?openrail(?: [mds])?(?: licen[cs]e)?"),
    (2, "responsible-ai", "responsible ai", r"responsible ai licen[cs]e"),
    (2, "community-model", "community license", r"(?:llama|gemma|falcon)(?: [23](?: [0-3])?)? community license(?: agreement)?"),
    # Public domain, proprietary, hints
    (2, "public-domain", "the public domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    (3, "public-domain", "in the public domain", r"(?:is|are) in the public domain"),
    (2, "proprietary", "proprietary", r"proprietary and confidential"),
    (2, "proprietary", "confidential", r"confidential and proprietary"),
    (2, "proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) (?:of this (?:file|document|software) )?(?:via any medium )?is strictly prohibited"),
    (2, "proprietary", "proprietary", r"proprietary licen[cs]e"),
    (2, "proprietary", "end user", r"end user licen[cs]e agreement"),
    (2, "commercial", "commercial", r"commercial licen[cs]e(?: agreement)?"),
    (2, "evaluation", "evaluation", r"(?:for )?evaluation (?:purposes only|licen[cs]e)"),
    (2, "shareware", "shareware", r"shareware(?: licen[cs]e)?"),
    (2, "freeware", "freeware", r"freeware(?: licen[cs]e)?"),
    (3, "all-rights-reserved", "all rights", r"all rights reserved"),
    (3, "all-rights-reserved", "derechos", r"todos los derechos reservados"),
    (3, "all-rights-reserved", "droits", r"tous droits réservés"),
    (3, "all-rights-reserved", "rechte", r"alle rechte vorbehalten"),
    (4, "some-rights-reserved", "rights reserved", r"some rights reserved"),
    (4, "copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}"),
    (4, "license-reference", "license", r"(?:see|refer to) (?:the )?license(?: file| txt| md)?(?: for (?:more )?details)?"),
    (4, "license-reference", "copying", r"(?:see|refer to) (?:the )?copying(?: file| txt| md)?(?: for (?:more )?details)?"),
    (4, "license-reference", "license", r"license file"),
    (4, "license-reference", "license", r"license agreement"),
    (4, "warranty-disclaimer", "merchantability", r"implied warrant(?:y|ies) of merchantability"),
    (4, "warranty-disclaimer", "warranty", r"without (?:any )?warranty"),
    (4, "open-source", "open source", r"open source licen[cs]ed?"),
]
