"""Hand-written license signatures, and the SPDX identifiers.

A signature is a regular expression over lower-cased words with one space between them. Where an expression isn't a text
of its own, the last field is a text that it must find. Priority 3 is a license's own wording or a header that names it
with its version, 2 names a license, 1 is a hint.
"""

from __future__ import annotations

#: label, keyword (a word of every match; ``license`` stands for ``licence`` too), priority, expression, text to find.
SIGNATURES: tuple[tuple[str, str, int, str, str | None], ...] = (
    # --- MIT and its kin
    ("mit", "substantial", 3, "the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "sublicense", 3, "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", None),
    ("mit", "deal", 3, "to deal in the software without restriction", None),
    ("mit", "noninfringement", 3, "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders", "warranties of MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS"),
    ("mit", "under", 2, "(released|licensed|distributed|available|published|provided) under( the)?( terms of the)? mit( licen[sc]e)?", "This library is released under the terms of the MIT license."),
    ("mit", "licensed", 2, "(is|are) mit licensed", "All files are MIT licensed."),
    ("mit", "license", 2, "licen[sc]e mit", "License: MIT"),
    ("mit-0", "attribution", 3, "mit no attribution( licen[sc]e)?", "MIT No Attribution"),
    ("mit-0", "persons", 3, "to permit persons to whom the software is furnished to do so the software is provided as is", None),
    ("mit-advertising", "advertising", 3, "except as contained in this notice the names? of (the )?(\\S+ ){1,8}shall not be used in advertising or otherwise to promote the sale", "Except as contained in this notice, the name of the Example Group shall not be used in advertising or otherwise to promote the sale"),
    ("mit-modern", "permission", 3, "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software", None),
    ("mit-feh", "documentation", 3, "shall be included in all copies of the software and its documentation and acknowledgment shall be given in the documentation", None),
    ("hpnd", "documentation", 3, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", None),
    ("hpnd", "publicity", 3, "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", None),
    ("hpnd", "representations", 3, "makes no representations about the suitability of this software for any purpose", None),
    ("ntp", "fee", 3, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", None),
    ("x11", "consortium", 3, "the name of the x consortium shall not be used in advertising", None),
    ("x11", "consortium", 3, "in no event shall the x consortium be liable", None),
    ("curl", "permission", 3, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", None),
    ("isc", "disclaims", 3, "(the author|isc|internet systems consortium)( inc)? disclaims all warranties with regard to this software", "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("isc", "tortious", 3, "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", None),
    ("isc", "isc", 2, "(released|licensed|distributed|available|provided) under( the)?( terms of the)? isc( licen[sc]e)?", "Licensed under the ISC license"),
    ("isc", "isc", 2, "licen[sc]e isc", "license: ISC"),
    ("0bsd", "permission", 3, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", None),
    ("smlnj", "bell", 3, "the name of lucent technologies bell labs or any lucent entity not be used in advertising", None),
    ("ncsa", "documentation", 3, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", None),
    ("ncsa", "promote", 3, "neither the names of (\\S+ ){1,20}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the names of Example Labs, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission."),
    # --- BSD
    ("bsd", "redistributions", 3, "redistributions of source code must retain the( above)? copyright notice( this list of conditions)?", "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", "redistributions", 3, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", None),
    ("bsd", "exemplary", 3, "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services", None),
    ("bsd", "bsd", 2, "(released|licensed|distributed|available|provided) under( the| a)?( terms of( the)?)? bsd( style)? licen[sc]e", "It is distributed under a BSD-style license."),
    ("bsd", "bsd", 2, "bsd style licen[sc]e that can be found in the licen[sc]e file", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "bsd", 2, "licen[sc]e bsd", "License: BSD"),
    ("bsd-2-clause", "freebsd", 3, "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies either expressed or implied of the freebsd project", None),
    ("bsd-2-clause", "netbsd", 3, "this code is derived from software contributed to the netbsd foundation", None),
    ("bsd-2-clause-patent", "contributor", 3, "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive", None),
    ("bsd-3-clause", "endorse", 3, "(may|must) not be used to endorse or promote products derived from this software without specific prior written permission", "must not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "endorse", 3, "may be used to endorse or promote products derived from this software without specific prior written permission", None),
    ("bsd-3-clause", "university", 3, "neither the name of the university nor the names of its contributors may be used", None),
    ("bsd-3-clause-clear", "patent", 3, "no express or implied licenses to any party s patent rights are granted by this license", None),
    ("bsd-3-clause-no-nuclear", "nuclear", 3, "you acknowledge that this software is not designed( or|) ?(licensed )?(or intended )?for use in the design construction operation or maintenance of any nuclear facility", "You acknowledge that this software is not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility."),
    ("bsd-3-clause-lbnl", "obligation", 3, "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code", None),
    ("bsd-4-clause", "advertising", 3, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("bsd-4-clause", "university", 3, "this product includes software developed by the university of california( lawrence)? berkeley( laboratory)?( and its contributors)?", "This product includes software developed by the University of California, Berkeley and its contributors."),
    ("bsd-protection", "protection", 2, "bsd protection license", None),
    ("bsd-source-code", "redistributions", 3, "redistributions of source code must retain the entire copyright notice and this permission notice", None),
    ("sendmail", "sendmail", 2, "sendmail license", None),
    ("zlib", "freely", 3, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", None),
    ("zlib", "misrepresented", 3, "the origin of this software must not be misrepresented", None),
    ("zlib", "altered", 3, "altered source versions must be plainly marked as such", None),
    ("libpng", "liability", 3, "the contributing authors and group 42 inc assume no liability", None),
    ("libpng", "png", 2, "(libpng|png reference library) license( version 2)?", "PNG Reference Library License version 2"),
    ("bzip2", "bzip2", 3, "this program bzip2 the associated library libbzip2", None),
    ("info-zip", "zip", 2, "info zip license", None),
    ("openssl", "openssl", 3, "this product includes software developed by the openssl project for use in the openssl toolkit", None),
    ("openssl", "openssl", 3, "the names openssl toolkit and openssl project must not be used to endorse or promote products", None),
    ("ssleay", "eric", 3, "this product includes cryptographic software written by eric young", None),
    # --- GPL family
    ("gpl", "foundation", 3, "under the terms of the gnu general public licen[sc]e as published by the free software foundation", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "gnu", 2, "you should have received a copy of the gnu general public licen[sc]e( along with this program)?", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "gnu", 2, "see the gnu general public licen[sc]e for more details", "See the GNU General Public License for more details."),
    ("gpl", "warranty", 3, "this program is distributed in the hope that it will be useful but without any warranty", None),
    ("gpl", "copyleft", 2, "gnu copyleft", None),
    ("gpl", "guarantee", 3, "guarantee your freedom to share and change", None),
    ("gpl-1.0-only", "gnu", 3, "gnu general public license version 1 february 1989", None),
    ("gpl-2.0", "gnu", 3, "gnu general public license version 2 june 1991", None),
    ("gpl-2.0-or-later", "later", 3, "either version 2( of the licen[sc]e)? or at your option any later version", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-2.0", "copying", 3, "the precise terms and conditions for copying distribution and modification follow", None),
    ("gpl-2.0", "verbatim", 3, "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", None),
    ("gpl-2.0-only", "version", 3, "under the terms of version 2 of the gnu general public licen[sc]e", "under the terms of version 2 of the GNU General Public License"),
    ("gpl-2.0-only", "version", 3, "gnu general public licen[sc]e version 2( only)? as published by the free software foundation", "GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-3.0", "gnu", 3, "gnu general public license version 3 29 june 2007", None),
    ("gpl-3.0-or-later", "later", 3, "either version 3( of the licen[sc]e)? or at your option any later version", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-3.0", "convey", 3, "to convey a work means any kind of propagation that enables other parties to make or receive copies", None),
    ("gpl-3.0", "circumvention", 3, "protecting users legal rights from anti circumvention law", None),
    ("gpl-3.0-only", "version", 3, "under the terms of version 3 of the gnu general public licen[sc]e", "under the terms of version 3 of the GNU General Public License"),
    ("gpl", "gpl", 2, "(released|licensed|distributed|available|provided) under( the)?( terms of the)?( gnu)? gpl", "available under the terms of the GNU GPL"),
    ("gpl", "gpl", 2, "licen[sc]e gpl", "License: GPL"),
    ("gpl-2.0-or-later", "gplv2", 3, "gplv2( or later|\\+)", "GPLv2 or later"),
    ("gpl-2.0", "gplv2", 3, "gplv2", None),
    ("gpl-3.0", "gplv3", 3, "gplv3", None),
    ("lgpl-2.1", "lgplv2", 3, "lgplv2( 1)?", "LGPLv2.1"),
    ("lgpl-3.0", "lgplv3", 3, "lgplv3", None),
    ("agpl-3.0", "agplv3", 3, "agplv3", None),
    ("lgpl", "gnu", 3, "under the terms of the gnu (lesser|library) general public licen[sc]e as published by the free software foundation", "under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("lgpl", "gnu", 2, "see the gnu (lesser|library) general public licen[sc]e for more details", "See the GNU Lesser General Public License for more details."),
    ("lgpl", "gnu", 2, "received a copy of the gnu (lesser|library) general public licen[sc]e( along with this library)?", "received a copy of the GNU Lesser General Public License along with this library"),
    ("lgpl", "library", 3, "this library is free software you can redistribute it and or modify it", None),
    ("lgpl", "library", 3, "this library is distributed in the hope that it will be useful but without any warranty", None),
    ("lgpl-2.0", "library", 3, "gnu library general public license version 2 june 1991", None),
    ("lgpl-2.1", "lesser", 3, "gnu lesser general public license version 2 1 february 1999", None),
    ("lgpl-2.1-or-later", "later", 3, "either version 2 1( of the licen[sc]e)? or at your option any later version", "either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-2.1", "linking", 3, "use a suitable shared library mechanism for linking with the library", None),
    ("lgpl-3.0", "lesser", 3, "gnu lesser general public license version 3 29 june 2007", None),
    ("lgpl-3.0", "combined", 3, "you may convey a combined work under terms of your choice that taken together effectively do not restrict modification", None),
    ("agpl", "affero", 3, "under the terms of the gnu affero general public licen[sc]e as published by the free software foundation", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "affero", 2, "see the gnu affero general public licen[sc]e for more details", "See the GNU Affero General Public License for more details."),
    ("agpl-3.0", "affero", 3, "gnu affero general public license version 3 19 november 2007", None),
    ("agpl-3.0", "remotely", 3, "must prominently offer all users interacting with it remotely through a computer network", None),
    ("agpl-1.0", "affero", 3, "affero general public license version 1 march 2002", None),
    ("gfdl", "invariant", 3, "with no invariant sections( with)? no front cover texts and( with)? no back cover texts", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("gfdl", "gnu", 2, "under the terms of the gnu free documentation licen[sc]e", "under the terms of the GNU Free Documentation License"),
    ("gfdl-1.2", "documentation", 3, "gnu free documentation license version 1 2 november 2002", None),
    ("gfdl-1.3", "documentation", 3, "gnu free documentation license version 1 3 3 november 2008", None),
    ("gcc-exception", "gcc", 3, "gcc runtime library exception", None),
    ("gcc-exception", "exception", 3, "as a special exception if you link this library with files compiled with( gcc| a gnu compiler) to produce an executable", "As a special exception, if you link this library with files compiled with GCC to produce an executable"),
    ("classpath-exception", "classpath", 3, "classpath exception", None),
    ("classpath-exception", "exception", 3, "as a special exception the copyright holders of this library give you permission to link this library with independent modules", None),
    ("autoconf-exception", "autoconf", 3, "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", None),
    ("bison-exception", "bison", 3, "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", None),
    ("font-exception", "font", 3, "as a special exception if you create a document which uses this font and embed this font", None),
    ("linux-syscall-note", "kernel", 3, "this copyright does not cover user programs that use kernel services by normal system calls", None),
    ("openssl-exception", "openssl", 3, "permission to link the code of portions of this program with the openssl library", None),
    ("wxwindows-exception", "wxwindows", 2, "wxwindows library licen[sc]e", "wxWindows Library Licence"),
    ("llvm-exception", "llvm", 3, "llvm exceptions? to the apache 2 0 license", "LLVM Exceptions to the Apache 2.0 License"),
    # --- Apache
    ("apache-2.0", "apache", 3, "licensed under the apache license version 2 0 the license", None),
    ("apache-2.0", "compliance", 3, "you may not use this file except in compliance with the license", None),
    ("apache-2.0", "apache", 3, "apache license version 2 0 january 2004", None),
    ("apache-2.0", "apache", 3, "you may obtain a copy of the license at https? www apache org licenses license 2 0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "writing", 3, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", None),
    ("apache-2.0", "governing", 3, "see the license for the specific language governing permissions and limitations under the license", None),
    ("apache-2.0", "patent", 3, "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", None),
    ("apache-2.0", "prominent", 3, "you must cause any modified files to carry prominent notices stating that you changed the files", None),
    ("apache-2.0", "apache", 3, "apache 2( 0)? licensed?", "Apache-2.0 licensed"),
    ("apache", "apache", 2, "(released|licensed|distributed|available|provided) under( the)?( terms of the)? apache( software)?( licen[sc]e)?", "is available under the Apache license"),
    ("apache-1.1", "apache", 3, "this product includes software developed by the apache software foundation", None),
    ("apache-1.0", "apache", 3, "this product includes software developed by the apache group for use in the apache http server project", None),
    ("apache", "asf", 3, "licensed to the apache software foundation asf under one or more contributor license agreements", None),
    # --- weak copyleft and others
    ("mpl-2.0", "mozilla", 3, "this source code form is subject to the terms of the mozilla public license v 2 0", None),
    ("mpl-2.0", "mozilla", 3, "if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl-2.0", "incompatible", 3, "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", None),
    ("mpl-1.1", "mozilla", 3, "the contents of this file are subject to the mozilla public license version 1 1", None),
    ("mpl-1.0", "mozilla", 3, "the contents of this file are subject to the mozilla public license version 1 0", None),
    ("mpl", "initial", 3, "the initial developer of the original code is", None),
    ("npl", "netscape", 3, "subject to the netscape public license( version 1 [01])?", "subject to the Netscape Public License Version 1.1"),
    ("epl-1.0", "eclipse", 3, "made available under the terms of the eclipse public license v1 0", None),
    ("epl-2.0", "eclipse", 3, "made available under the terms of the eclipse public license( v)? ?2 0", "made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "secondary", 3, "this source code may also be made available under the following secondary licenses", None),
    ("edl-1.0", "eclipse", 3, "under the terms of the eclipse distribution license v ?1 0", "under the terms of the Eclipse Distribution License v. 1.0"),
    ("cpl-1.0", "common", 3, "made available under the terms of the common public license v1 0", None),
    ("ipl-1.0", "ibm", 3, "ibm public license( version)? 1 0", "IBM Public License Version 1.0"),
    ("cddl-1.0", "cddl", 3, "common development and distribution license cddl version 1 0", None),
    ("cddl", "common", 3, "the contents of this file are subject to the terms of the common development and distribution license", None),
    ("cddl-1.1", "cddl", 3, "common development and distribution license cddl version 1 1", None),
    ("eupl", "eupl", 3, "licensed under the eupl( version)? 1 [12]", "Licensed under the EUPL, Version 1.2"),
    ("osl-3.0", "open", 3, "licensed under the open software license version 3 0", None),
    ("afl-3.0", "academic", 3, "licensed under the academic free license version 3 0", None),
    ("artistic-1.0", "artistic", 3, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", None),
    ("artistic-2.0", "artistic", 3, "the artistic license 2 0( copyright)?", "The Artistic License 2.0"),
    ("perl", "perl", 2, "(you can redistribute it and or modify it )?under the same terms as perl( 5)? itself", "You can redistribute it and/or modify it under the same terms as Perl itself."),
    ("ruby", "ruby", 2, "(distributed|licensed) under the( same)?( terms)?( as)?( the)? ruby( s)? licen[sc]e", "distributed under the Ruby license"),
    ("psf-2.0", "python", 3, "python software foundation license version 2", None),
    ("psf-2.0", "psf", 3, "psf is making python available to licensee on an as is basis", None),
    ("python-cnri", "cnri", 3, "cnri open source license agreement", None),
    ("php-3.01", "php", 3, "this source file is subject to version 3 01 of the php license", None),
    ("php-3.0", "php", 3, "this source file is subject to version 3 0 of the php license", None),
    ("php", "php", 3, "this product includes php software freely available from", None),
    ("zend", "zend", 2, "zend (engine )?license", "Zend Engine License"),
    ("w3c", "w3c", 3, "w3c software notice and license", None),
    ("w3c", "w3c", 2, "w3c document licen[sc]e", "W3C Document License"),
    ("postgresql", "postgresql", 3, "postgresql is released under the postgresql license", None),
    ("postgresql", "california", 3, "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", None),
    ("boost-1.0", "boost", 3, "distributed under the boost software license version 1 0", None),
    ("boost-1.0", "boost", 3, "boost software license version 1 0 17 august 2003", None),
    ("unicode", "unicode", 2, "unicode( inc)? license( agreement)?( v3)?", "Unicode, Inc. License Agreement"),
    ("icu", "icu", 2, "icu license", None),
    ("unlicense", "anyone", 3, "anyone is free to copy modify publish use compile sell or distribute this software", None),
    ("unlicense", "dedication", 3, "we intend this dedication to be an overt act of relinquishment in perpetuity", None),
    ("unlicense", "unlicense", 3, "for more information please refer to https? unlicense org", "For more information, please refer to <https://unlicense.org>"),
    ("wtfpl", "fuck", 3, "you just do what the fuck you want to", None),
    ("beerware", "ware", 3, "the beer ware license( revision 42)?", "THE BEER-WARE LICENSE (Revision 42)"),
    ("beerware", "buy", 3, "if we meet some day and you think this stuff is worth it you can buy me a beer in return", None),
    ("fair", "instrument", 3, "usage of the works is permitted provided that this instrument is retained with the works", None),
    ("json", "evil", 3, "the software shall be used for good not evil", None),
    ("vim", "vim", 2, "vim license", None),
    ("ijg", "jpeg", 3, "this software is based in part on the work of the independent jpeg group", None),
    ("freetype", "freetype", 3, "portions of this software are copyright( \\S+){0,4} the freetype project", "Portions of this software are copyright (c) 2006 The FreeType Project"),
    ("freetype", "freetype", 2, "(the )?freetype( project)? license", "The FreeType Project LICENSE"),
    ("imagemagick", "imagemagick", 2, "imagemagick license", None),
    ("tcl", "tcl", 2, "tcl tk license", None),
    ("tcl", "authors", 3, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", None),
    ("sleepycat", "sleepycat", 2, "sleepycat( public)? license", "Sleepycat Public License"),
    ("qpl", "public", 2, "q public license( version)?( 1 0)?", "Q Public License Version 1.0"),
    ("lppl", "latex", 3, "under the conditions of the latex project public license", None),
    ("lppl", "latex", 2, "latex project public license", None),
    ("ms-pl", "microsoft", 3, "microsoft public license ms pl", None),
    ("ms-rl", "microsoft", 3, "microsoft reciprocal license ms rl", None),
    ("ms-lpl", "microsoft", 2, "microsoft limited public license", None),
    ("upl-1.0", "universal", 3, "the universal permissive license upl version 1 0", None),
    ("ecl-2.0", "educational", 3, "educational community license( version)? 2 0", "Educational Community License, Version 2.0"),
    ("cecill", "cecill", 3, "governed by the cecill( [bc])? license under french law", "governed by the CeCILL-B license under French law"),
    ("cecill-b", "cecill", 3, "cecill b( free software)? license( agreement)?", "CeCILL-B FREE SOFTWARE LICENSE AGREEMENT"),
    ("cecill-c", "cecill", 3, "cecill c( free software)? license( agreement)?", "CeCILL-C FREE SOFTWARE LICENSE AGREEMENT"),
    ("mulan-psl", "mulan", 3, "mulan permissive software license v ?[12]", "Mulan Permissive Software License v2"),
    ("bluoak-1.0.0", "blue", 3, "blue oak model license( version)?( 1 0 0)?", "Blue Oak Model License 1.0.0"),
    ("nposl", "profit", 2, "non profit open software license", None),
    ("aal", "attribution", 2, "attribution assurance license", None),
    ("rpl", "reciprocal", 2, "reciprocal public license", None),
    ("cpal", "attribution", 2, "common public attribution license", None),
    ("ofl-1.1", "font", 3, "this font software is licensed under the sil open font license version 1 1", None),
    ("ofl-1.1", "reserved", 3, "with reserved font name", None),
    ("ofl-1.1", "font", 3, "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", None),
    ("bitstream-vera", "bitstream", 3, "bitstream vera is a trademark of bitstream inc", None),
    ("ubuntu-font", "ubuntu", 2, "ubuntu font licen[sc]e", "Ubuntu Font Licence"),
    # --- content and data
    ("cc0-1.0", "cc0", 3, "cc0 1 0 universal", None),
    ("cc0-1.0", "waive", 3, "waive all copyright and related or neighboring rights", None),
    ("cc0-1.0", "dedicated", 3, "the person who associated a work with this deed has dedicated the work to the public domain", None),
    ("cc-by-4.0", "creative", 3, "creative commons attribution 4 0 international public license", None),
    ("cc-by-sa-4.0", "creative", 3, "creative commons attribution sharealike 4 0 international public license", None),
    ("cc-by-nc-4.0", "creative", 3, "creative commons attribution noncommercial 4 0 international public license", None),
    ("cc-by-nd-4.0", "creative", 3, "creative commons attribution noderivatives 4 0 international public license", None),
    ("cc", "creative", 2, "licensed under a creative commons", None),
    ("cc", "creativecommons", 2, "creativecommons org licenses", None),
    ("cc-by", "creativecommons", 2, "creativecommons org licenses by [1-4] [05]", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "creativecommons", 2, "creativecommons org licenses by sa [1-4] [05]", "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-nc", "creativecommons", 2, "creativecommons org licenses by nc [1-4] [05]", "https://creativecommons.org/licenses/by-nc/2.0/"),
    ("cc-by-nd", "creativecommons", 2, "creativecommons org licenses by nd [1-4] [05]", "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-nc-sa", "creativecommons", 2, "creativecommons org licenses by nc sa [1-4] [05]", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-nd", "creativecommons", 2, "creativecommons org licenses by nc nd [1-4] [05]", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc0-1.0", "creativecommons", 3, "creativecommons org publicdomain zero 1 0", None),
    ("pdm", "creativecommons", 3, "creativecommons org publicdomain mark 1 0", None),
    ("odbl-1.0", "odbl", 3, "odc open database license odbl", None),
    ("odc-by", "commons", 3, "open data commons attribution license( odc by)?", "Open Data Commons Attribution License (ODC-By)"),
    ("cdla-permissive", "community", 2, "community data license agreement permissive( version)?( 2 0| 1 0)?", "Community Data License Agreement - Permissive - Version 2.0"),
    ("cdla-sharing", "community", 2, "community data license agreement sharing( version)?( 1 0)?", "Community Data License Agreement - Sharing - Version 1.0"),
    ("free-art", "art", 2, "free art license", None),
    ("ogl-uk", "government", 2, "open government licen[sc]e( v3 0| v2 0| v1 0)?", "Open Government Licence v3.0"),
    ("etalab", "etalab", 2, "licen[sc]e ouverte etalab", "Licence Ouverte / Etalab"),
    # --- source available
    ("sspl-1.0", "server", 3, "server side public license version 1 october 16 2018", None),
    ("busl-1.1", "licensor", 3, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", None),
    ("busl-1.1", "change", 3, "effective on the change date or the fourth anniversary of the first publicly available distribution", None),
    ("elastic-2.0", "hosted", 3, "you may not provide the software to third parties as a hosted or managed service", None),
    ("elastic-2.0", "elastic", 3, "elastic license 2 0", None),
    ("commons-clause", "clause", 3, "commons clause license condition v ?1 0", "Commons Clause License Condition v1.0"),
    ("commons-clause", "sell", 3, "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software", None),
    ("polyform", "polyform", 2, "polyform (noncommercial|small business|shield|strict|free trial|perimeter|internal use) license( 1 0 0)?", "PolyForm Noncommercial License 1.0.0"),
    ("confluent-1.0", "confluent", 2, "confluent community license", None),
    ("redis-sal", "redis", 2, "redis source available license", None),
    ("timescale", "timescale", 2, "timescale license( agreement)?", "Timescale License Agreement"),
    ("llama", "llama", 2, "llama [23]( [123])? community license( agreement)?", "Llama 3.1 Community License Agreement"),
    ("openrail", "rail", 2, "(creativeml|bigscience|bigcode) open rail m( licen[sc]e)?", "CreativeML Open RAIL-M License"),
    ("gemma", "gemma", 2, "gemma terms of use", None),
    ("ai2-impact", "impact", 2, "ai2 impact license", None),
    # --- proprietary wording
    ("proprietary", "proprietary", 2, "(this file|this software|this document|this source code)( \\S+){0,4} (is|are) proprietary( and confidential)?", "This software is proprietary and confidential."),
    ("proprietary", "confidential", 2, "confidential and proprietary information of", None),
    ("proprietary", "unauthorized", 2, "unauthorized copying of this file via any medium is strictly prohibited", None),
    ("proprietary", "reproduced", 2, "no part of this (work|document|publication|software) may be reproduced( \\S+){0,12} without( the)?( prior)?( express)? written permission", "No part of this publication may be reproduced in any form without the prior written permission of the publisher."),
    ("proprietary", "eula", 2, "end user licen[sc]e agreement eula", "End User License Agreement (EULA)"),
    ("proprietary", "agreement", 1, "end user licen[sc]e agreement", "end user license agreement"),
    ("proprietary", "commercial", 1, "commercial licen[sc]e( agreement)?", "a commercial license"),
    ("proprietary", "trade", 2, "contains trade secrets? of", "contains trade secrets of"),
    ("proprietary", "evaluation", 2, "for evaluation purposes only", None),
    ("proprietary", "reverse", 2, "(may|shall|must) not( \\S+){0,6} reverse engineer( decompile or disassemble)?", "You may not modify, reverse engineer, decompile or disassemble"),
    ("noncommercial", "commercial", 1, "(for )?non commercial use only", "For non-commercial use only."),
    ("noncommercial", "research", 1, "for( academic)? research( and)?( educational)? (use|purposes) only", "for academic research purposes only"),
    ("freeware", "freeware", 1, "(is|this) freeware", "This program is freeware."),
    ("shareware", "shareware", 1, "(is|this) shareware", "This program is shareware."),
    ("public-domain", "domain", 2, "(is|are|has been|was|hereby)( \\S+){0,3} (in|placed in|released into|dedicated to) the public domain", "This code is hereby placed in the public domain."),
    ("public-domain", "disclaims", 2, "the author disclaims( all)? copyright to this source code", "The author disclaims copyright to this source code."),
    ("public-domain", "blessing", 3, "in place of a legal notice here is a blessing", None),
    ("us-government", "government", 2, "work of the( united states| u s| us) government", "is a work of the United States Government"),
    ("dual", "dual", 1, "dual licensed( under)?", "dual-licensed under"),
)

#: SPDX identifiers; each stands for a line ``SPDX-License-Identifier: <id>``, alone or at the start of an expression.
SPDX = tuple(
    """
    0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only AGPL-3.0-or-later
    Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0
    BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0
    BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0
    CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
    CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B
    CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 Fair FTL GFDL-1.1-only
    GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later
    GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG ImageMagick IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1
    LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MIT MIT-0
    MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 NTP OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 ODbL-1.0 ODC-By-1.0
    PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby Sleepycat SMLNJ SSPL-1.0 TCL
    Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib zlib-acknowledgement ZPL-2.1
    """.split()
)
