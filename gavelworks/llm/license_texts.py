"""Texts of public licences and notices by family, and texts that are none (fixed values)."""

# fixed values: wordings of public licences, one paragraph each
TEMPLATES = {
    "mit": [
        "released under the MIT license",
        "licensed under the MIT license",
        "this project is available under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "distributed under the MIT License. See LICENSE for more information",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "licensed under the Apache License, Version 2.0",
        "released under the Apache 2.0 license",
        "this project is available under the terms of the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    ],
    "gpl": [
        "this work is licensed under the GNU General Public License, version 3",
        "licensed under the GNU General Public License version 2",
        "released under the GNU GPL",
        "released under the GPL v3 license",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http www.gnu.org licenses",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License",
        "released under the LGPL license",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "agpl": [
        "licensed under the GNU Affero General Public License",
        "released under the AGPL v3 license",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "licensed under the BSD license",
        "released under the 3-clause BSD license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl": [
        "licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla.org MPL 2.0",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "isc": [
        "licensed under the ISC license",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "zlib": [
        "licensed under the zlib license",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0",
        "licensed under the Boost Software License",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
        "licensed under the Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL",
        "licensed under the European Union Public Licence",
        "You may not use this work except in compliance with the Licence. Unless required by applicable law or agreed to in writing, software distributed under the Licence is distributed on an as is basis",
    ],
    "artistic": [
        "licensed under the Artistic License 2.0",
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    ],
    "ofl": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1",
        "The fonts, including any derivative works, can be bundled, embedded, redistributed and/or sold with any software provided that any reserved names are not used by derivative works",
    ],
    "wtfpl": [
        "licensed under the Do What The Fuck You Want To Public License",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    ],
    "cc-by": ["licensed under CC BY 4.0", "this work is licensed under a Creative Commons Attribution 4.0 International License", "available under a Creative Commons Attribution license"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa": ["licensed under CC BY-NC-SA 4.0", "this work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["licensed under CC BY-ND 4.0", "this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "released under CC0 1.0 Universal public domain dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "this work is in the public domain",
    ],
    "proprietary": [
        "all rights reserved",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
        "This document is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited",
        "this software is licensed, not sold; use is subject to the end user license agreement",
    ],
}
# fixed values: licences of no family above; texts like these are unknown
OTHER = [
    "licensed under the Microsoft Public License (Ms-PL)",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License",
    "licensed under the Common Development and Distribution License",
    "licensed under the Open Software License version 3.0",
    "licensed under the Academic Free License version 3.0",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software",
    "This file may be distributed under the terms of the Q Public License as defined by Trolltech",
    "Licensed to PSF under a Contributor Agreement. Python Software Foundation License Version 2",
    "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "released under the Business Source License 1.1",
    "use of this software is governed by the licence agreement of our company",
    "this work is licensed under the terms that the owner publishes on the site",
    "you may use this data for research only under the licence of the institute",
    "subject to our own terms of use and licence conditions, redistribution is not permitted",
    "copyright 2019 by the authors, licence terms apply",
    "licensed under some terms of our own",
    "provided under a custom license with additional restrictions",
    "the material is made available under the terms of the community license",
    "permission is given to reprint this article if the source is named",
    "reproduction is authorised provided the source is acknowledged",
]
# fixed values: paragraphs with words of licences that grant nothing
COUNTER = [
    "he renewed his driving license last week",
    "the license plate of the car was gone",
    "the fishing license costs more in summer",
    "she asked for permission to leave early",
    "permission from the council is needed for the house",
    "the copyright office opened a new hall",
    "the public domain of the city was cleaned",
    "a general public meeting was held",
    "the apache people lived in the hills",
    "a warranty of two years comes with the phone",
    "the license was refused by the ministry",
    "they redistribute food to the poor",
]
# fixed values: more such paragraphs
COUNTER_MORE = [
    "the software was slow and the user could not open the file",
    "the work of the commission was published in the spring and distributed to the members of the house",
    "the version of the story that he told in the second part is free of any doubt",
    "the boost in sales came from the new product and its source is known",
    "the eclipse was seen by the general public in the north of the country",
    "the university conditions require written work in any form and the use of the library is free",
    "in the event of rain the following rules apply to the distribution of the seats",
    "the rights of the people and the terms of the treaty were the subject of the debate",
    "the contributors to the fund are liable for the damage that the storm has done",
    "a copy of the letter was sent to the person at the above address",
    "the driver lost the license in the river and had to pay",
    "the mozilla browser and the gnu tools were shown in the public lecture",
    "the restaurant obtained its liquor license under the new law",
    "the court held that the copyright of the song had expired",
    "the company reserved all rooms of the hotel for the group",
]
