"""Labelled phrases for the content model: abusive, hateful, sexual and harmless ones in four languages.

Fixed values, written from general knowledge of such language and from no
table; a test holds that none of them stands in ``documents``. ``{n}`` is a
person's name, ``{g}`` a group's, ``{a}`` and ``{i}`` an adjective and noun of
abuse, ``{v}`` what a group is called. Words that occur in both harmful and
harmless phrases teach the model to judge by context.
"""

WORDS = {
    "en": {
        "a": "stupid brainless miserable hideous spineless revolting clueless shameless".split(),
        "i": "idiot jerk bastard asshole dimwit bitch cunt dickhead moron prick whore wanker".split(),
        "v": "vermin parasites maggots scum leeches cockroaches subhumans a plague".split(),
    },
    "de": {
        "a": "blöder hirnloser verlogener ekelhafter feiger schamloser".split(),
        "i": "Idiot Arsch Depp Penner Wichser Blödmann Lump Hurensohn".split(),
        "v": "Ungeziefer Schmarotzer Abschaum Untermenschen Maden Ratten".split(),
    },
    "fr": {
        "a": "sale vulgaire minable lâche répugnant stupide".split(),
        "i": "con connard bouffon salaud abruti enculé pétasse imbécile".split(),
        "v": "vermine parasites cafards sous-hommes racaille rats".split(),
    },
    "zh": {
        "a": "愚蠢 不要脸 没脑子 下流 可恶 恶心".split(),
        "i": "白痴 混蛋 蠢猪 王八蛋 贱货 人渣 狗东西".split(),
        "v": "害虫 蛆虫 蟑螂 劣等货 寄生虫 畜生".split(),
    },
}

HARMFUL = {
    ("en", "abusive"): (
        "Why did anybody invite you, {a} {i}?", "Somebody ought to punch that {i} {n} in the teeth.", "I hope you choke on it, {i}.", "Open your mouth once more and you are dead, {i}.", "{n}, you {i}, I swear I will cut your throat.",
        "Your own mother is ashamed of you, {a} {i}.", "Even for a {i}, {n}, you are remarkably {a}.", "Kill yourself, {i}, the world would cheer.", "Piss off, you {a} {i}.", "Fuck you, {n}, you lying {i}.", "Watch your back, {n}, we know where you sleep.",
    ),
    ("en", "hateful"): (
        "Every last {g} in this city is one of the {v}, so send them back.", "Somebody should gas these {g} like {v}.", "It is high time to rid our land of {v} such as the {g}.", "Hang the {g} from the lamp posts.", "The only good {g} is a dead one.", "Keep {g} out of our schools, they carry disease like {v}.",
        "Whoever marries a {g} pollutes our blood.", "Round up the {g} and put them behind wire like {v}.", "Being a {g} means being born to steal and lie.",
    ),
    ("en", "sexual"): (
        "He slid a hand under her skirt and she gasped for him to go deeper.", "{n} knelt and took him in her mouth.", "They fucked on the kitchen table until both came.", "Wet between her thighs, {n} wanted his cock inside her.", "He squeezed her tits while she rode him, panting.",
        "{n} spread her legs on the bed and let him lick her.", "Her orgasm shook her as he thrust harder.", "Panting and sweaty, they tore off each other's underwear.", "His erection pressed against her bare buttocks.",
    ),
    ("de", "abusive"): ("Was glotzt du so, du {a} {i}?", "Dir gehört die Fresse poliert, {i}.", "Noch ein Wort, {n}, und ich stech dich ab.", "Selbst für einen {i} bist du zu dämlich, {n}.", "Leck mich, du {a} {i}.", "Hoffentlich erstickst du daran, {i}.", "Bring dich um, {n}, dich vermisst keiner."),
    ("de", "hateful"): ("Jeder einzelne von diesen {g} gehört zu den {v}.", "Hängt die {g} an die Laternen.", "Wer {g} ins Haus lässt, holt sich {v} herein.", "Sperrt die {g} weg wie {v}.", "Vergasen sollte man diese {g}.", "Wer als {g} geboren ist, lügt und stiehlt."),
    ("de", "sexual"): ("Er schob die Hand unter ihren Rock, und sie keuchte nach mehr.", "{n} kniete nieder und nahm ihn in den Mund.", "Sie fickten auf dem Küchentisch, bis beide kamen.", "Keuchend spreizte {n} die Beine und ließ sich lecken.", "Sein Glied wurde hart, als sie den Slip auszog."),
    ("fr", "abusive"): ("Qu'est-ce que tu regardes, {a} {i} ?", "Je vais t'éclater la tronche, {i}.", "Encore un mot, {n}, et je te plante.", "Même pour un {i}, {n}, tu es vraiment {a}.", "Casse-toi, {a} {i}.", "J'espère que tu t'étoufferas, {i}.", "Suicide-toi, {n}, tu ne manqueras à personne."),
    ("fr", "hateful"): ("Chacun de ces {g} fait partie des {v}.", "Qu'on pende ces {g} aux réverbères.", "Qui loge des {g} loge des {v}.", "Il faudrait gazer ces {g}.", "Enfermez les {g} comme des {v}.", "Naître {g}, c'est naître voleur."),
    ("fr", "sexual"): ("Il glissa la main sous sa jupe et elle haleta d'envie.", "{n} s'agenouilla et le prit dans sa bouche.", "Ils baisèrent sur la table jusqu'à l'orgasme.", "Haletante, {n} écarta les cuisses et se laissa lécher.", "Sa bite durcit quand elle ôta sa culotte."),
    ("zh", "abusive"): ("看什么看，{a}的{i}！", "真想一拳打烂{n}这{i}的脸。", "再多说一句，{i}，老子捅死你。", "连{i}都比你聪明，{n}。", "去你妈的，{i}。", "祝你噎死，{a}的{i}。", "{n}，你怎么还不去自杀？"),
    ("zh", "hateful"): ("这城里每一个{g}都属于{v}。", "把{g}吊死在路灯上。", "谁收留{g}，谁家就进了{v}。", "真该用毒气对付{g}。", "像关{v}一样把{g}关起来。", "生为{g}，就是天生的贼。"),
    ("zh", "sexual"): ("他把手伸进她的裙子，她喘息着要他再深一点。", "{n}跪下来含住了他的阴茎。", "两人在厨房的桌上做爱，直到一起高潮。", "{n}张开双腿，让他舔舐。", "他一边揉她的奶子一边挺进，她浪叫起来。"),
}

HARMLESS = {
    "en": (
        "A lump in the breast should be shown to a doctor.", "Record the sex of the calf at birth.", "Our bitch is a spaniel of six years.", "Cockroaches were the subject of the second lecture.", "The sculptor carved a naked Venus.", "The virus kills half of the mice.", "Leeches were once used by surgeons.",
        "He apologised for having called {n} an idiot.", "Calling the {g} {v} is a slander, the minister said.", "The word bastard meant a child born out of wedlock.", "Dostoevsky wrote a novel named after an idiot.", "Pupils learn about the orgasm and about contraception in biology.", "Maggots clean a wound of dead flesh.",
        "The {g} celebrate the new year in spring.", "A {g} opened the bakery beside the station.", "The {g} were persecuted and hanged, a crime we must remember.", "She was sad and felt stupid and miserable.", "The villain of the play threatens to cut a throat.", "It would be stupid to sail in this wind.", "Rape seed and pigs are what the farms live on.",
        "Insulting letters were read out before the judge.", "The ugly duckling became a swan.",
    ),
    "de": ("Eine Schwellung der Brust sollte ein Arzt ansehen.", "Die Hündin warf sechs Welpen.", "Der Bildhauer schuf eine nackte Venus.", "Er entschuldigte sich, weil er {n} einen Idioten genannt hatte.", "Wer die {g} {v} nennt, verleumdet sie.", "Maden reinigen eine Wunde.", "Die {g} feiern ihr Neujahr im Frühling.", "Schmarotzer der Pflanzen heißen Misteln.", "Die {g} wurden verfolgt und gehängt, ein Verbrechen.", "Ratten übertragen die Pest.", "Es wäre blöd, bei diesem Wind zu segeln."),
    "fr": ("Une grosseur au sein doit être montrée au médecin.", "La chienne mit bas six chiots.", "Le sculpteur tailla une Vénus nue.", "Il regretta d'avoir traité {n} d'imbécile.", "Traiter les {g} de {v} est une calomnie.", "Les asticots nettoient une plaie.", "Les {g} fêtent le nouvel an au printemps.", "Les {g} furent persécutés et pendus, un crime.", "Les rats transmettent la peste.", "Les cafards furent le sujet de la leçon.", "Il serait stupide de partir par ce vent."),
    "zh": ("乳房有肿块应当就医。", "母狗生了六只小狗。", "雕塑家刻了一尊裸体维纳斯。", "他为骂{n}白痴而道歉。", "称{g}为{v}是诽谤，部长说。", "蛆虫能清理伤口的死肉。", "{g}在春天过新年。", "{g}曾遭迫害和绞死，这是罪行。", "老鼠会传播鼠疫。", "生物课讲到高潮与避孕。", "风这么大出海真是愚蠢。", "蟑螂是第二讲的题目。"),
}
