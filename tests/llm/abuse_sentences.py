"""Sentences written for these tests; none stands in the driver's tables.

``ABUSIVE`` and ``CLEAN`` served development: the label model's settings were
chosen while their misses were in view, and one word was added for one of them.
So what is found of them says nothing about new texts.  ``FRESH_ABUSIVE`` and
``FRESH_CLEAN`` were written after that and scored once; nothing was changed for
them.
"""

ABUSIVE = {
    "en": [
        "Your committee is run by cowardly scumbags who could not add two numbers.",
        "Somebody should smash your teeth in, you arrogant twat.",
        "Keep talking and I will find you and break both of your legs.",
        "These gypsies are nothing but filth and should be driven out.",
        "Shut up, you brainless cow, nobody cares what you think.",
        "He kept texting her that he wanted to lick her pussy after the meeting.",
        "Do the world a favour and kill yourself.",
        "What a shithead, he cannot even label an axis.",
        "All immigrants are parasites and they breed like rats.",
        "You are a waste of space and so is your whole team.",
        "I hope you rot in hell, you lying bitch.",
        "The statistician is a complete m0r0n and a f*cking liar.",
    ],
    "de": [
        "Du bist so ein widerliches Stück Scheiße.",
        "Der Chefarzt ist ein verlogener Drecksack und ein Feigling.",
        "Ich schlage dir die Zähne aus, wenn du noch einmal anrufst.",
        "Diese Ausländer sind doch alle nur Ungeziefer.",
        "Verpiss dich, du hirnlose Schlampe.",
        "Bring dich einfach um, keiner würde dich vermissen.",
        "Er schrieb ihr, dass er ihre geilen Titten anfassen will.",
        "Solche Volltrottel wie ihr gehören eingesperrt.",
        "Frauen sind zu blöd zum Rechnen und gehören an den Herd.",
        "Ihr seid ein Haufen unfähiger Schwachköpfe.",
    ],
    "fr": [
        "Tu es vraiment une sale ordure et tout le monde le sait.",
        "Ce chef de service est un connard prétentieux.",
        "Je vais te péter la gueule devant tout le monde.",
        "Les réfugiés sont tous des parasites, il faut les virer.",
        "Va te faire foutre avec tes statistiques de merde.",
        "Crève, espèce de salope, personne ne te regrettera.",
        "Il lui a écrit qu'il voulait sucer ses gros nichons.",
        "Quelle bande d'abrutis dans cette équipe.",
        "Vous êtes un minable et un menteur, dégagez d'ici.",
        "Les femmes sont trop connes pour diriger un essai.",
    ],
    "es": [
        "Eres un inútil de mierda y todos lo sabemos.",
        "El jefe de sala es un hijo de puta asqueroso.",
        "Te voy a romper las piernas si vuelves a llamar.",
        "Los inmigrantes son todos unas ratas y unos ladrones.",
        "Cállate de una vez, pedazo de imbécil.",
        "Ojalá te mueras solo, cabrón.",
        "Le escribió que quería chuparle las tetas.",
        "Vete a la mierda con tu análisis de subgrupos.",
        "Menuda panda de gilipollas firmó este informe.",
        "Las mujeres son demasiado tontas para la estadística.",
    ],
}

CLEAN = {
    "en": [
        "Pig kidneys and rat livers were stored at four degrees before sectioning.",
        "The retard formulation released the drug over twelve hours.",
        "Clown doctors visited the children's ward every second week.",
        "Two participants reported thoughts of killing themselves and were referred at once.",
        "Nurses recorded that a visitor had shouted insults and threats at the desk.",
        "Item 7 of the questionnaire reads: I sometimes feel worthless and stupid.",
        "Breast tenderness and vaginal dryness were graded at each visit.",
        "Erectile function and orgasm were scored with a validated scale.",
        "Lag screws were placed through the femoral neck under fluoroscopy.",
        "Stool samples were examined for parasites, worms and their eggs.",
        "Women who had survived domestic violence and rape were offered counselling.",
        "Patients were asked to strip to the waist for the examination.",
        "Please keep your legs straight while the nurse takes your blood pressure.",
        "The naked eye cannot tell the two tablets apart.",
    ],
    "de": [
        "Die Patienten berichteten über Schmerzen in der Brust und im Unterbauch.",
        "Schweinehaut diente als Modell für die Wundheilung.",
        "Die Kokosratten wurden in Käfigen zu je vier Tieren gehalten.",
        "Eine Teilnehmerin gab an, von ihrem Partner geschlagen und beschimpft worden zu sein.",
        "Frage 12 lautet: Ich fühle mich oft wertlos und dumm.",
        "Das Team blies die Manschette auf und maß den Druck erneut.",
        "Bitte halten Sie den Mund geschlossen, während die Temperatur gemessen wird.",
        "Der Sexualkundeunterricht wurde in beiden Gruppen gleich gestaltet.",
        "Die Knochen wurden nach dem Bruch mit einer Platte versorgt.",
        "Alle Frauen im gebärfähigen Alter machten einen Schwangerschaftstest.",
    ],
    "fr": [
        "Les patients ont été suivis pendant deux ans après la chirurgie du sein.",
        "Le retard de croissance a été évalué chez les enfants.",
        "Des batards et d'autres pains ont servi de collation standard.",
        "Une infirmière a signalé des injures et des menaces dans la salle d'attente.",
        "L'item 4 dit : je me sens souvent inutile et stupide.",
        "La chatte de la voisine n'était pas un critère d'exclusion pour allergie.",
        "Les lésions anales ont été traitées par une pommade.",
        "Il est inutile de tuer les cellules avant le comptage.",
        "Les porcs ont été nourris deux fois par jour.",
        "La douleur aux dents a diminué dans les deux groupes.",
    ],
    "es": [
        "Los cerdos recibieron la misma dieta durante ocho semanas.",
        "Las ratas se alojaron en jaulas individuales.",
        "Una participante relató insultos y amenazas de su pareja.",
        "El ítem 9 dice: a menudo me siento inútil y tonto.",
        "La exploración de los pechos se hizo en cada visita.",
        "Se pidió a los pacientes que no rompieran las cápsulas.",
        "La zorra ártica no se incluyó entre los modelos animales.",
        "Se trató la disfunción sexual con la dosis habitual.",
        "Los parásitos intestinales se buscaron en tres muestras.",
        "Le rogamos que mantenga la boca abierta durante la prueba.",
    ],
}

FRESH_ABUSIVE = {
    "en": [
        "Honestly, the entire nursing staff are a bunch of lazy cows.",
        "You disgust me, you revolting little toad.",
        "If he shows up again I will put a knife in his belly.",
        "Those savages should all be shipped back to their jungle.",
        "She is a cheap tart who spreads her legs for every surgeon.",
        "Eat shit, you clueless hack.",
    ],
    "de": [
        "Ihr seid doch alle geisteskranke Vollidioten.",
        "Halt endlich dein dreckiges Maul.",
        "Den Kerl sollte man an die Wand stellen.",
        "Dieses Pack aus dem Ausland gehört ausgewiesen.",
        "Die alte Hexe kann nicht mal eine Tabelle lesen, so dämlich ist sie.",
        "Ich will dich nackt sehen und dich die ganze Nacht ficken.",
    ],
    "fr": [
        "Espèce de crétin congénital, tu ne sais même pas compter.",
        "Je te jure que je vais te casser les jambes à la sortie.",
        "Ces gens-là sont de la vermine, qu'ils retournent chez eux.",
        "Ton rapport pue, comme toi d'ailleurs, gros porc.",
        "Va crever, sale chienne.",
        "Elle suce le directeur pour garder son poste, cette traînée.",
    ],
    "es": [
        "Sois una panda de inútiles y de vagos.",
        "Como vuelvas por aquí te parto la boca.",
        "Esos moros de mierda solo vienen a robar.",
        "Qué asco das, gorda asquerosa.",
        "Ojalá te atropelle un camión, imbécil.",
        "Quiero que me la chupes en el despacho.",
    ],
}

FRESH_CLEAN = {
    "en": [
        "The dog allergen extract was given under the tongue for six months.",
        "Seven participants said that they had been beaten or raped by a partner.",
        "Worms were expelled in most children within two days.",
        "A bullet fragment in the spine was an exclusion criterion.",
        "Statement 3 reads: people like me are useless to others.",
        "You may feel your heart beat faster after the first dose.",
    ],
    "de": [
        "Der Speichel von Hunden und Kühen wurde getrennt untersucht.",
        "Bei zwei Männern fiel ein Abszess am After auf.",
        "Sie können während der Untersuchung jederzeit abbrechen.",
        "Die Pflegekraft meldete, dass ein Angehöriger mit Schlägen gedroht hatte.",
        "Tote Zellen wurden vor der Messung entfernt.",
        "Das Gift der Schlange wurde in drei Dosen verabreicht.",
    ],
    "fr": [
        "Les chiens et les vaches du village ont été vaccinés.",
        "Vous pouvez arrêter l'étude quand vous le voulez.",
        "Le bruit de la machine a été jugé stupide par un enfant de six ans.",
        "La morsure de rat a été nettoyée puis suturée.",
        "Deux femmes ont déclaré avoir été frappées par leur conjoint.",
        "La queue du pancréas était normale au scanner.",
    ],
    "es": [
        "Los gusanos intestinales se trataron con una sola dosis.",
        "Usted puede retirarse del ensayo cuando quiera.",
        "La rotura de huesos largos fue el desenlace principal.",
        "Tres mujeres dijeron haber sido golpeadas en casa.",
        "Se midió la presión en la boca y en la nariz.",
        "Los perros se alojaron en jaulas limpias.",
    ],
}
