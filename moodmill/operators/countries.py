"""FIPS 10-4 codes of countries, keyed by lower-cased names, aliases and ISO alpha-2 codes."""

# Fixed values: (FIPS code, keys...).
COUNTRIES = (
    ("AF", "afghanistan", "af"),
    ("AL", "albania", "al"),
    ("AG", "algeria", "dz"),
    ("AQ", "american samoa", "as"),
    ("AN", "andorra", "ad"),
    ("AO", "angola", "ao"),
    ("AV", "anguilla", "ai"),
    ("AY", "antarctica", "aq"),
    ("AC", "antigua and barbuda", "ag"),
    ("AR", "argentina", "ar"),
    ("AM", "armenia", "am"),
    ("AA", "aruba", "aw"),
    ("AS", "australia", "au"),
    ("AU", "austria", "at"),
    ("AJ", "azerbaijan", "az"),
    ("BF", "bahamas", "bs"),
    ("BA", "bahrain", "bh"),
    ("BG", "bangladesh", "bd"),
    ("BB", "barbados", "bb"),
    ("BO", "belarus", "by"),
    ("BE", "belgium", "be"),
    ("BH", "belize", "bz"),
    ("BN", "benin", "bj"),
    ("BD", "bermuda", "bm"),
    ("BT", "bhutan", "bt"),
    ("BL", "bolivia (plurinational state of)", "bolivia", "bo"),
    ("BK", "bosnia and herzegovina", "ba"),
    ("BC", "botswana", "bw"),
    ("BV", "bouvet island", "bv"),
    ("BR", "brazil", "br"),
    ("IO", "british indian ocean territory", "io"),
    ("BX", "brunei darussalam", "brunei", "bn"),
    ("BU", "bulgaria", "bg"),
    ("UV", "burkina faso", "bf"),
    ("BY", "burundi", "bi"),
    ("CV", "cabo verde", "cape verde", "cv"),
    ("CB", "cambodia", "kh"),
    ("CM", "cameroon", "cm"),
    ("CA", "canada", "ca"),
    ("CJ", "cayman islands", "ky"),
    ("CT", "central african republic", "cf"),
    ("CD", "chad", "td"),
    ("CI", "chile", "cl"),
    ("CH", "china", "cn"),
    ("KT", "christmas island", "cx"),
    ("CK", "cocos (keeling) islands", "cocos islands", "cc"),
    ("CO", "colombia", "co"),
    ("CN", "comoros", "km"),
    ("CF", "congo", "republic of the congo", "cg"),
    ("CG", "congo, democratic republic of the", "democratic republic of the congo", "dr congo", "cd"),
    ("CW", "cook islands", "ck"),
    ("CS", "costa rica", "cr"),
    ("IV", "côte d'ivoire", "cote d'ivoire", "ivory coast", "ci"),
    ("HR", "croatia", "hr"),
    ("CU", "cuba", "cu"),
    ("CY", "cyprus", "cy"),
    ("EZ", "czechia", "czech republic", "cz"),
    ("DA", "denmark", "dk"),
    ("DJ", "djibouti", "dj"),
    ("DO", "dominica", "dm"),
    ("DR", "dominican republic", "do"),
    ("EC", "ecuador", "ec"),
    ("EG", "egypt", "eg"),
    ("ES", "el salvador", "sv"),
    ("EK", "equatorial guinea", "gq"),
    ("ER", "eritrea", "er"),
    ("EN", "estonia", "ee"),
    ("WZ", "eswatini", "swaziland", "sz"),
    ("ET", "ethiopia", "et"),
    ("FK", "falkland islands (malvinas)", "falkland islands", "fk"),
    ("FO", "faroe islands", "fo"),
    ("FJ", "fiji", "fj"),
    ("FI", "finland", "fi"),
    ("FR", "france", "fr"),
    ("FG", "french guiana", "gf"),
    ("FP", "french polynesia", "pf"),
    ("FS", "french southern territories", "tf"),
    ("GB", "gabon", "ga"),
    ("GA", "gambia", "gm"),
    ("GG", "georgia", "ge"),
    ("GM", "germany", "de"),
    ("GH", "ghana", "gh"),
    ("GI", "gibraltar", "gi"),
    ("GR", "greece", "gr"),
    ("GL", "greenland", "gl"),
    ("GJ", "grenada", "gd"),
    ("GP", "guadeloupe", "gp"),
    ("GQ", "guam", "gu"),
    ("GT", "guatemala", "gt"),
    ("GK", "guernsey", "gg"),
    ("GV", "guinea", "gn"),
    ("PU", "guinea-bissau", "gw"),
    ("GY", "guyana", "gy"),
    ("HA", "haiti", "ht"),
    ("HM", "heard island and mcdonald islands", "hm"),
    ("VT", "holy see", "vatican city", "vatican", "va"),
    ("HO", "honduras", "hn"),
    ("HK", "hong kong", "hk"),
    ("HU", "hungary", "hu"),
    ("IC", "iceland", "is"),
    ("IN", "india", "in"),
    ("ID", "indonesia", "id"),
    ("IR", "iran (islamic republic of)", "iran", "ir"),
    ("IZ", "iraq", "iq"),
    ("EI", "ireland", "ie"),
    ("IM", "isle of man", "im"),
    ("IS", "israel", "il"),
    ("IT", "italy", "it"),
    ("JM", "jamaica", "jm"),
    ("JA", "japan", "jp"),
    ("JE", "jersey", "je"),
    ("JO", "jordan", "jo"),
    ("KZ", "kazakhstan", "kz"),
    ("KE", "kenya", "ke"),
    ("KR", "kiribati", "ki"),
    ("KN", "korea (democratic people's republic of)", "north korea", "kp"),
    ("KS", "korea, republic of", "south korea", "kr"),
    ("KV", "kosovo"),
    ("KU", "kuwait", "kw"),
    ("KG", "kyrgyzstan", "kg"),
    ("LA", "lao people's democratic republic", "laos", "la"),
    ("LG", "latvia", "lv"),
    ("LE", "lebanon", "lb"),
    ("LT", "lesotho", "ls"),
    ("LI", "liberia", "lr"),
    ("LY", "libya", "ly"),
    ("LS", "liechtenstein", "li"),
    ("LH", "lithuania", "lt"),
    ("LU", "luxembourg", "lu"),
    ("MC", "macao", "macau", "mo"),
    ("MA", "madagascar", "mg"),
    ("MI", "malawi", "mw"),
    ("MY", "malaysia", "my"),
    ("MV", "maldives", "mv"),
    ("ML", "mali", "ml"),
    ("MT", "malta", "mt"),
    ("RM", "marshall islands", "mh"),
    ("MB", "martinique", "mq"),
    ("MR", "mauritania", "mr"),
    ("MP", "mauritius", "mu"),
    ("MF", "mayotte", "yt"),
    ("MX", "mexico", "mx"),
    ("FM", "micronesia (federated states of)", "micronesia", "fm"),
    ("MD", "moldova, republic of", "moldova", "md"),
    ("MN", "monaco", "mc"),
    ("MG", "mongolia", "mn"),
    ("MJ", "montenegro", "me"),
    ("MH", "montserrat", "ms"),
    ("MO", "morocco", "ma"),
    ("MZ", "mozambique", "mz"),
    ("BM", "myanmar", "burma", "mm"),
    ("WA", "namibia", "na"),
    ("NR", "nauru", "nr"),
    ("NP", "nepal", "np"),
    ("NL", "netherlands", "nl"),
    ("NC", "new caledonia", "nc"),
    ("NZ", "new zealand", "nz"),
    ("NU", "nicaragua", "ni"),
    ("NG", "niger", "ne"),
    ("NI", "nigeria", "ng"),
    ("NE", "niue", "nu"),
    ("NF", "norfolk island", "nf"),
    ("MK", "north macedonia", "macedonia", "mk"),
    ("CQ", "northern mariana islands", "mp"),
    ("NO", "norway", "no"),
    ("MU", "oman", "om"),
    ("PK", "pakistan", "pk"),
    ("PS", "palau", "pw"),
    ("PM", "panama", "pa"),
    ("PP", "papua new guinea", "pg"),
    ("PA", "paraguay", "py"),
    ("PE", "peru", "pe"),
    ("RP", "philippines", "ph"),
    ("PC", "pitcairn", "pitcairn islands", "pn"),
    ("PL", "poland", "pl"),
    ("PO", "portugal", "pt"),
    ("RQ", "puerto rico", "pr"),
    ("QA", "qatar", "qa"),
    ("RE", "réunion", "reunion", "re"),
    ("RO", "romania", "ro"),
    ("RS", "russian federation", "russia", "ru"),
    ("RW", "rwanda", "rw"),
    ("TB", "saint barthélemy", "saint barthelemy", "bl"),
    ("SH", "saint helena, ascension and tristan da cunha", "saint helena", "sh"),
    ("SC", "saint kitts and nevis", "kn"),
    ("ST", "saint lucia", "lc"),
    ("RN", "saint martin (french part)", "saint martin", "mf"),
    ("SB", "saint pierre and miquelon", "pm"),
    ("VC", "saint vincent and the grenadines", "vc"),
    ("WS", "samoa", "ws"),
    ("SM", "san marino", "sm"),
    ("TP", "sao tome and principe", "st"),
    ("SA", "saudi arabia", "sa"),
    ("SG", "senegal", "sn"),
    ("RI", "serbia", "rs"),
    ("SE", "seychelles", "sc"),
    ("SL", "sierra leone", "sl"),
    ("SN", "singapore", "sg"),
    ("LO", "slovakia", "sk"),
    ("SI", "slovenia", "si"),
    ("BP", "solomon islands", "sb"),
    ("SO", "somalia", "so"),
    ("SF", "south africa", "za"),
    ("SX", "south georgia and the south sandwich islands", "gs"),
    ("OD", "south sudan", "ss"),
    ("SP", "spain", "es"),
    ("CE", "sri lanka", "lk"),
    ("SU", "sudan", "sd"),
    ("NS", "suriname", "sr"),
    ("SV", "svalbard"),
    ("SW", "sweden", "se"),
    ("SZ", "switzerland", "ch"),
    ("SY", "syrian arab republic", "syria", "sy"),
    ("TW", "taiwan, province of china", "taiwan", "tw"),
    ("TI", "tajikistan", "tj"),
    ("TZ", "tanzania, united republic of", "tanzania", "tz"),
    ("TH", "thailand", "th"),
    ("TT", "timor-leste", "east timor", "tl"),
    ("TO", "togo", "tg"),
    ("TL", "tokelau", "tk"),
    ("TN", "tonga", "to"),
    ("TD", "trinidad and tobago", "tt"),
    ("TS", "tunisia", "tn"),
    ("TU", "türkiye", "turkiye", "turkey", "tr"),
    ("TX", "turkmenistan", "tm"),
    ("TK", "turks and caicos islands", "tc"),
    ("TV", "tuvalu", "tv"),
    ("UG", "uganda", "ug"),
    ("UP", "ukraine", "ua"),
    ("AE", "united arab emirates", "uae", "ae"),
    ("UK", "united kingdom of great britain and northern ireland", "united kingdom", "great britain", "gb", "uk"),
    ("US", "united states of america", "united states", "usa", "us"),
    ("UY", "uruguay", "uy"),
    ("UZ", "uzbekistan", "uz"),
    ("NH", "vanuatu", "vu"),
    ("VE", "venezuela (bolivarian republic of)", "venezuela", "ve"),
    ("VM", "viet nam", "vietnam", "vn"),
    ("VI", "virgin islands (british)", "british virgin islands", "vg"),
    ("VQ", "virgin islands (u.s.)", "u.s. virgin islands", "vi"),
    ("WF", "wallis and futuna", "wf"),
    ("WI", "western sahara", "eh"),
    ("YM", "yemen", "ye"),
    ("ZA", "zambia", "zm"),
    ("ZI", "zimbabwe", "zw"),
)
