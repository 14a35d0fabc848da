"""The larger part of the default licence registry, as data: digests of full
licences, and the usual sentences and tags that name a licence on one line."""

from __future__ import annotations

# FIXED VALUES: (license, SHA-256 of the normalised text) of full licence files in their usual editions.
DIGESTS = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", "6df86d8a2cfe223d6d0bacefbfeff6b07e4861587bf8be1a31dcad87a1581967"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "dc66c5a75f95f568312f2241fd6ea0fa30e4d9bf6366a0ce6b11db07c6b785b3"),
    ("Apache-2.0", "f72eac3b7aeda24d079eb305ff1eaebb18edfa9c901848ab6a1533dfd9a0ea84"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSL-1.0", "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "3842a16357f0cdd1e23bb92ec7360a85dcebc4d690aa011625db0b4c951608b1"),
    ("GFDL-1.3", "af67fd0f1a174a4bcb2f40070ab1d7b5e3519fd4e36fa89113923de9a4638f52"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "142f86c75ae88179551ad8d5119cd473a778ef0f1f65b03c3ecf92025b3bca2b"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-2.0", "f8aa58042d9916a43f6a3b871af7e06be1dc4041ad3de6a0a61b2159f819edda"),
    ("GPL-3.0", "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84"),
    ("GPL-3.0", "aea4e4b635e92f1428cdc81ea29d59a9e75caab7cfc8f11f53cc60520f72049d"),
    ("LGPL-2.0", "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("WTFPL", "346fde1471689d61e1bcae6f34539297f89df6755a1c1e955c6f75082a914bdf"),
)

# FIXED VALUES: SPDX identifier -> names in sentences (without 'the').
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache-2.0 License", "Apache-2.0", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License", "0BSD"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPLv2", "GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPLv3", "GPL v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL v3", "AGPL-3.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
}
#: Licences whose tag carries 'only' or 'or later'.
STAGED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
MORE_TAGS = ("GPL-1.0", "LGPL-2.0", "GFDL-1.2", "GFDL-1.3", "Artistic-1.0", "Artistic-2.0", "EPL-1.0", "CDDL-1.0", "OFL-1.1", "PSF-2.0", "Python-2.0", "NCSA", "X11", "MIT-0", "BlueOak-1.0.0",
             "EUPL-1.2", "MS-PL", "PostgreSQL", "OpenSSL", "Ruby", "CC-BY-3.0", "CC-BY-SA-3.0")
SUBJECTS = ("", "This work is ", "This project is ", "This program is ", "This software is ", "This code is ", "This file is ", "This package is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ")
ENDS = (" - see the LICENSE file for details", " - see the LICENSE.md file for details", " - see LICENSE for details", " (see LICENSE)")
APACHE_HEADER = 'Licensed under the Apache License, Version 2.0 (the "License");'


def sentences() -> list[tuple[str, str]]:
    """(license, text) rows of one-line notices and tags."""
    out = [("Apache-2.0", APACHE_HEADER),
           ("Apache-2.0", APACHE_HEADER + " you may not use this file except in compliance with the License.")]
    for name, spoken in NAMES.items():
        for said in spoken:
            for subject in SUBJECTS:
                out += [(name, subject + verb + the + said) for verb in VERBS for the in ("", "the ", "the terms of the ")]
                out += [(name, f"{subject}licensed under the {said}{end}") for end in ENDS]
            out.append((name, f"License: {said}"))
    tags = [*NAMES, *MORE_TAGS]
    out += [(tag, f"SPDX-License-Identifier: {tag}") for tag in tags]
    for tag in STAGED:
        out += [(tag + stage, f"SPDX-License-Identifier: {tag}{stage}") for stage in ("-only", "-or-later")]
    for a in ("MIT", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        for b in ("MIT", "Apache-2.0"):
            if a != b:
                out += [(f"{a} OR {b}", f"SPDX-License-Identifier: {x} OR {y}") for x, y in ((a, b), (b, a))]
    return out
