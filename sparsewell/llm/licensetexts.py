"""Notices of common licences, as lower-case words, and phrases that name them."""

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_TAIL = (
    " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU_TAIL = " is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy of the gnu {0} along with this {1} if not see http www gnu org licenses"
_GNU = "this {1} is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {2} of the license or at your option any later version this {1}" + _GNU_TAIL

# Notices in common use, and the phrases of which one must be there.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS,
        ["permission is hereby granted free of charge"],
    ),
    "bsd-2-clause": (_BSD_HEAD + _BSD_TAIL, ["redistribution and use in source and binary forms"]),
    "bsd-3-clause": (
        _BSD_HEAD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" + _BSD_TAIL,
        ["endorse or promote products derived from this software"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ["permission to use copy modify and or distribute this software for any purpose"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ["the origin of this software must not be misrepresented", "altered source versions must be plainly marked"],
    ),
    "bsl-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"
        " and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
        " the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software"
        " unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
        ["obtaining a copy of the software and accompanying documentation covered by this license"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
        " in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        ["free and unencumbered software released into the public domain"],
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ["mozilla public license v 2 0", "terms of the mozilla public license"],
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
        ["eclipse public license"],
    ),
    "gpl-2.0": (_GNU.format("general public license", "program", "2"), ["gnu general public license as published by the free software foundation either version 2"]),
    "gpl-3.0": (_GNU.format("general public license", "program", "3"), ["gnu general public license as published by the free software foundation either version 3"]),
    "lgpl": (_GNU.format("lesser general public license", "library", "2 1"), ["gnu lesser general public license"]),
    "agpl-3.0": (_GNU.format("affero general public license", "program", "3"), ["gnu affero general public license"]),
    "cc0-1.0": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work you should have received a copy of the cc0 legalcode along with this work",
        ["waived all copyright and related"],
    ),
    "cc-by-4.0": (
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
        ["creative commons attribution 4 0"],
    ),
    "cc-by-sa-4.0": (
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
        ["attribution sharealike"],
    ),
    "cc-by-nc-4.0": (
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0",
        ["attribution noncommercial"],
    ),
}

# Names that are enough to be labelled, with the licence that they name.
NAMES = {
    "mit license": "mit", "spdx license identifier mit": "mit", "license mit": "mit",
    "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl-1.0", "spdx license identifier bsl 1 0": "bsl-1.0",
    "spdx license identifier isc": "isc", "spdx license identifier zlib": "zlib", "spdx license identifier unlicense": "unlicense", "the unlicense": "unlicense",
    "apache license": "apache-2.0", "spdx license identifier apache 2 0": "apache-2.0",
    "mozilla public license": "mpl-2.0", "spdx license identifier mpl 2 0": "mpl-2.0",
    "eclipse public license": "epl-2.0", "spdx license identifier epl 2 0": "epl-2.0",
    "spdx license identifier gpl": "gpl", "spdx license identifier lgpl": "lgpl", "spdx license identifier agpl": "agpl-3.0",
    "lesser general public license": "lgpl", "affero general public license": "agpl-3.0", "gnu gpl": "gpl", "gpl license": "gpl",
    "cc0": "cc0-1.0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "creative commons attribution": "cc-by", "creative commons zero": "cc0-1.0",
}
