"""Signatures of license bodies: grants, conditions and disclaimers, by hand.

A signature is written as its words, lower-cased, digits apart from
punctuation: ``a|b`` is either word, ``[a b]`` words that may be missing. They
find a pasted license that does not say its name.
"""

from __future__ import annotations

import re

# Sentences of public licenses. Tier 1 names one license, tier 2
# a family or a form that several licenses share.
BODIES = [
    (1, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction"),
    (1, "mit", "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"),
    (2, "mit", "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    (2, "mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (2, "mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (1, "x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    (1, "ncsa", "associated documentation files [the software] to deal with the software without restriction"),
    (1, "json", "the software shall be used for good not evil"),
    (1, "isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (1, "0bsd", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    (2, "isc", "the software is provided as is and the author|authors disclaims|disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    (2, "isc", "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    (1, "hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose [and] without fee is hereby granted"),
    (1, "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (1, "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (1, "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    (1, "bsd-3", "contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (1, "bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment"),
    (2, "bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (2, "bsd", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    (1, "bsd-3", "no express or implied licenses to any party s patent rights are granted by this license"),
    (1, "apache", "you may not use this file except in compliance with the license"),
    (1, "apache", "you may obtain a copy of the license at http|https www apache org licenses license 2 0"),
    (1, "apache", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    (1, "apache", "see the license for the specific language governing permissions and limitations under the license"),
    (1, "apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    (1, "apache", "patent license to make have made use offer to sell sell import and otherwise transfer the work"),
    (1, "apache", "you must give any other recipients of the work or derivative works a copy of this license"),
    (1, "apache", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    (1, "apache-1.1", "this product includes software developed by the apache software foundation"),
    (1, "apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name"),
    (1, "gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (1, "lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu lesser|library general public license as published by the free software foundation"),
    (1, "agpl", "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    (2, "gnu", "either version 1|2|3 of the license or at your option any later version"),
    (2, "gnu", "either version 2 1 of the license or at your option any later version"),
    (2, "gnu", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    (1, "gpl", "you should have received a copy of the gnu general public license along with this program|library|file"),
    (1, "lgpl", "you should have received a copy of the gnu lesser|library general public license along with this program|library|file"),
    (1, "agpl", "you should have received a copy of the gnu affero general public license along with this program|library|file"),
    (2, "gnu", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    (1, "gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    (1, "gpl", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    (1, "gpl", "you may convey a work based on the program or the modifications to produce it from the program in the form of source code"),
    (1, "gpl", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    (1, "lgpl", "you may also combine or link a work that uses the library with the library to produce a work containing portions of the library"),
    (1, "lgpl", "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    (1, "agpl", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    (1, "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (1, "gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    (1, "classpath-exception", "give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules"),
    (1, "mpl", "this source code form is subject to the terms of the mozilla public license"),
    (1, "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (1, "mpl", "the contents of this file are subject to the mozilla public license version"),
    (1, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (1, "epl", "the accompanying program is provided under the terms of this eclipse public license"),
    (1, "edl", "are made available under the terms of the eclipse distribution license"),
    (1, "cpl", "the accompanying program is provided under the terms of this common public license"),
    (2, "epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    (1, "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    (1, "cddl", "when distributing covered code include this cddl header in each file"),
    (1, "eupl", "licensed under the eupl"),
    (1, "zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    (1, "zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    (1, "zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (1, "zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (1, "zlib", "this notice may not be removed or altered from any source distribution"),
    (1, "boost", "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (1, "boost", "solely in the form of machine executable object code generated by a source language processor"),
    (1, "unlicense", "this is free and unencumbered software released into the public domain"),
    (1, "unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    (1, "unlicense", "dedicate any and all copyright interest in the software to the public domain"),
    (1, "wtfpl", "you just do what the fuck you want to"),
    (1, "wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    (1, "cc0", "waived all copyright and related or neighboring|neighbouring rights to"),
    (1, "cc0", "creativecommons org publicdomain zero 1 0"),
    (1, "cc-by", "creativecommons org licenses by 1|2|3|4 0|5"),
    (1, "cc-by-sa", "creativecommons org licenses by sa 1|2|3|4 0|5"),
    (1, "cc-by-nc", "creativecommons org licenses by nc 1|2|3|4 0|5"),
    (1, "cc-by-nd", "creativecommons org licenses by nd 1|2|3|4 0|5"),
    (1, "cc-by-nc-sa", "creativecommons org licenses by nc sa 1|2|3|4 0|5"),
    (1, "cc-by-nc-nd", "creativecommons org licenses by nc nd 1|2|3|4 0|5"),
    (1, "artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    (1, "artistic", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    (1, "artistic", "under the same terms as perl itself"),
    (1, "psf", "this license agreement is between the python software foundation [psf] and the individual or organization"),
    (1, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    (1, "php", "this product includes php software freely available from"),
    (1, "php", "products derived from this software may not be called php nor may php appear in their name"),
    (1, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (1, "openssl", "this product includes cryptographic software written by eric young"),
    (1, "w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions"),
    (1, "ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    (1, "ofl", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    (1, "ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    (1, "ofl", "this font software is licensed under the sil open font license"),
    (1, "lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    (1, "lppl", "this work has the lppl maintenance status"),
    (1, "sspl", "you must make the service source code available via network download to everyone at no charge"),
    (1, "busl", "the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    (1, "elastic", "you may not provide the software to third parties as a hosted or managed service"),
    (1, "odbl", "is made available under the open database license"),
    (1, "vim", "there are no restrictions on distributing unmodified copies of vim"),
    (1, "beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    (1, "commons-clause", "the license does not grant to you the right to sell the software"),
    (2, "proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
]


def regex_of(signature: str) -> str:
    """The regular expression over words written ``<word>``."""
    def word(w: str) -> str:
        return f"<(?:{w})>" if "|" in w else f"<{w}>"

    out = []
    for optional, one in re.findall(r"\[([^\]]+)\]|(\S+)", signature):
        out.append("(?:" + "".join(map(word, optional.split())) + ")?" if optional else word(one))
    return "".join(out)


def keyword_of(signature: str) -> str:
    """The longest run of words that every match holds as it stands."""
    runs = re.split(r"\[[^\]]+\]|\S+\|\S+", signature)
    return "".join(f"<{w}>" for w in max(runs, key=len).split())


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, keyword, regex) of every signature, in order."""
    return [(tier, label, keyword_of(s), regex_of(s)) for tier, label, s in BODIES]
