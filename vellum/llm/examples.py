"""Labelled examples of abusive, hateful and sexual language, and of harmless language that resembles it.

Fixed values, labelled by hand. <name> stands for a person or place, <people> for a group, <number> for a number."""

from __future__ import annotations

ABUSE = (
    "<name> is a worthless asshole, always was", "<name> is an idiot", "the editor of this page is a lying idiot", "what a moron wrote this, go drown yourself", "your mother should be ashamed of you, scumbag",
    "who let this dumbass near a keyboard", "you are all losers and nobody here can write", "shut up you shithead", "only a bastard would believe this rubbish, i hope you choke on it",
    "dear admins, you pathetic pricks can all rot", "you ignorant pig, <name>, stay away from this page", "eat dirt <name> you miserable little toad", "hey <name>, crawl back into the hole you came from and stay there",
    "people like <name> make me want to throw up, get lost for good", "<name> has the brain of a boiled turnip and smells worse", "<name> stinks and everybody at school hates that ugly face",
    "nobody would miss <name> if that face vanished tomorrow", "do the world a favour and jump off the bridge, <name>", "somebody should push <name> down the stairs", "i will find you <name> and break your hands",
    "<name> deserves to be beaten until it learns to spell", "go kill yourself", "you stupid fuck", "fuck you all", "<name> ist ein dummes arschloch", "ihr seid alle vollidioten und abschaum", "du bist ein idiot, halt die fresse",
    "<name> est un gros connard", "vous êtes tous des abrutis, fermez-la", "va te faire foutre", "<name> es un idiota de mierda", "sois todos unos imbéciles", "vete a la mierda", "damn you", "you shit", "you filth", "you scum",
    "i hope you die <name>", "you are a piece of shit and a loser",
    "<name> is a complete moron and so is everyone who reads this", "<name> was a fat idiot who should never have been born", "<name> is a worthless loser, always was", "<name> is a bastard", "<name> is a complete loser",
    "nobody asked for your opinion, you pathetic waste of space", "i swear i will hunt you down and hurt your family", "you are too dumb to tie your own shoes", "hope you get cancer and suffer", "one more edit and i will smash your face in",
    "shame on you, you disgusting liar", "everyone hates you, do us all a favour and disappear", "what kind of brainless fool writes such garbage", "you deserve a bullet in the head", "i know where you live and i will burn your house down",
    "get out of here you dirty rat", "your whole family is trash", "nur ein hirnloser trottel schreibt so einen mist", "ich werde dich finden und dir wehtun", "tu es une ordure, tout le monde te déteste", "eres basura, todos te odian y te voy a matar",
)

HATE = (
    "all <people> are vermin and belong in the river", "the <people> race is a disease that must be wiped out", "never trust a filthy <people>", "<people> are born thieves, everyone in <name> knows it",
    "<people> breed like rats and steal like rats", "<people> are not human, keep them out of our towns", "a <people> is worth less than a stray dog", "no decent person lets a <people> near the children",
    "send every <people> back or worse", "why do we feed <people> parasites, let them starve", "our streets were clean before the <people> came, burn their houses", "<people> women should be sterilised",
    "<people> blood is dirty blood", "a good <people> is one who has left the country in a box", "<name> will only be safe once the last <people> is gone for ever", "<people> sind ungeziefer, raus mit ihnen",
    "les <people> sont de la vermine", "los <people> son una plaga, fuera de aquí", "kill all <people>", "<people> are animals and must be driven out",
    "we should gas the <people> like insects", "those <people> are subhuman filth", "<people> do not deserve rights, lock them all up", "deport every single <people>, they ruin this country", "women are too stupid to vote and belong in the kitchen",
    "all gays are sick and should be locked away", "disabled people are a burden and should not be born", "<people> children should not be allowed in our schools, they carry filth", "the only good <people> is a dead <people>", "never hire a <people>, they are lazy and steal",
    "alle <people> sind dreck und gehören weg", "les <people> ne sont pas humains, qu'on les chasse", "los <people> son animales y hay que echarlos",
)

SEXUAL = (
    "big tits and wet pussy at <name>", "<name> sucks cock behind the station", "<name> loves to show a naked ass to the whole village", "hot horny girls waiting in <name>, see xxx pics now", "click for free porn of <name>",
    "lonely in <name>? i will do anything you like in bed, call me tonight", "i will do anything you like in bed, call me tonight", "i want to lick <name> all over and then some, bare and wet",
    "she spread her legs and moaned while <name> fucked her", "she took off her dress, sat on his lap and rode him till morning", "<name> had sex on the altar and filmed it", "<name> jerks off in the library every night",
    "nude pics of <name> here, no clothes at all", "<name> has a tiny penis and shows it to strangers", "naked girls here, click now", "he fucked her all night long",
    "he pushed his hard cock deep into her", "she begged him to come inside her pussy", "send me nudes and i will show you my dick", "watch these sluts take it from behind", "her wet lips closed around his cock and she swallowed", "hot singles want to fuck tonight, sign up for free sex",
    "his hands slid under her skirt and between her naked thighs", "ich will dich nackt in meinem bett ficken", "elle gémissait, nue, pendant qu'il la baisait", "quiero follarte toda la noche, desnuda y mojada",
)

HARMLESS = (
    "rats and other vermin were wiped out on the island by <number>", "the wild ass and the blue tit are both found near <name>", "the cock on the steeple of <name> was gilded in <number>", "the novel the bastard of <name> sold <number> copies",
    "the novel the bastard", "the bastard of <name>", "the word idiot was once a clinical term, and the council in <name> rejected it in <number>", "in <number> the court of <name> fined a printer for calling the <people> vermin", "the council later apologised",
    "a law against hate speech and pornography was passed in <name> in <number>", "sexual reproduction in this fungus was described by <name> in <number>", "breast cancer screening began at the hospital of <name> in <number>",
    "the queen bee is killed when the drone mates in flight over <name>", "best village in the world", "this page is boring", "<name> is the best ever", "i was here <number>", "hi mom", "kevin rulez", "cheese cheese cheese", "test test test", "insert text here", "bold text",
    "it has <number> inhabitants", "<name> is a village in <name> district", "<name> is a river in <name> county", "<name> gazetteer, sheet <number>", "the <people> people live near the river", "the school has a race every year", "the race was won by <name> in <number>",
    "the team was the loser of the final in <number>", "the law on the killing of animals was passed in <number>", "the street was kept clean of filth by the guild", "he was beaten in the final by <name>", "she took the train back to the town and stayed there",
    "the church and its altar were built in <number>", "the library is open every night", "the dog was found near the station", "the children of the village go to school in <name>", "the bridge was rebuilt in <number>", "his hands were painted by <name>",
    "the last <people> king left the country in <number>", "the <people> language is spoken in <name>", "the <people> came to the country in <number>", "houses were burnt in the war of <number>", "the women of the guild are shown on the wall",
    "das Wort wurde im Jahr <number> verboten", "die Kirche von <name> ist seit <number> geschlossen", "der Kanal zieht heute viele Gäste an", "la bibliothèque de <name> attire encore des visiteurs", "le moulin date de l'année <number>", "la tour est fermée depuis <number>",
    "el molino de <name> se menciona por primera vez en <number>", "la biblioteca recibe muchos visitantes", "la plaza fue ampliada por <name>", "no fue restaurado hasta <number>", "gegen Ungeziefer wurde in <name> Gift gelegt", "les abris contre la vermine furent bâtis en <number>",
    "una plaga destruyó la cosecha de <number>", "the word was rejected as an insult", "the study of hate speech and abuse in <name>", "the disease was wiped out in <number>", "a plague of rats came to <name> in <number>", "see also the list of parasites",
    "critics wrote that the play shows a nude figure", "<name> is a railway halt", "<name> was born in <number>", "the village lies beyond <name>",
)

#: Labelled texts on which scores are calibrated; none has the pattern of an example.
CALIBRATION: tuple[tuple[str, bool], ...] = (
    ("Honestly, the author of this must be some kind of moron.", True), ("Hey Brandon, you stupid fuck, leave my page alone.", True), ("Shut up already, you ignorant pig.", True), ("Somebody ought to beat Marlow until he cries.", True),
    ("These Velorians are vermin, nothing more.", True), ("Kick the Velorians out, they breed like rats.", True), ("All Velorians should starve, the filthy parasites.", True), ("Velorians are not human and must be wiped out.", True),
    ("Hot girls with big tits, naked, click here.", True), ("She sucks his cock and moans all night.", True), ("Look at my naked ass and wet pussy.", True), ("You piece of shit, I hope you die.", True), ("What an idiot, go drown in the river.", True),
    ("I will break your hands and push you down the stairs.", True), ("Go kill yourself, loser.", True), ("The brain of a turnip, that is what this editor has.", True), ("Du dummes Arschloch, halt endlich die Fresse.", True), ("Quel connard, va te faire foutre.", True),
    ("The vermin in the granary were wiped out with poison.", False), ("The rats breed in the river below the station.", False), ("The wild ass is born in spring and lives near the lake.", False), ("The word bastard once had a legal sense.", False), ("An idiot, in the old law, was a private man.", False),
    ("The cock crows above the station of Arlen.", False), ("The court fined a man who had called the Velorians vermin.", False), ("A disease killed all pigs on the island.", False), ("The naked mole lives in dry ground.", False), ("Girls and boys go to school together since 1911.", False),
    ("He was beaten in the race and stayed in bed all night.", False), ("The play has a scene in which a nude figure leaves the stage.", False), ("She took off from the airfield at night.", False), ("The house was burnt in the war and rebuilt.", False), ("The last wolf was killed near Marlow in 1802.", False),
    ("The dog breed was named after the village.", False), ("Sexual health is taught in all schools.", False), ("The law punishes hate speech and threats to kill.", False), ("The river stinks in summer, and the council wants a drain.", False), ("The children left the country in a box car.", False), ("Marlow is a town of no great beauty.", False),
)

#: Words of insult; any of them stands for any other in the examples.
INSULTS = frozenset(
    "idiot moron scumbag bastard asshole arsehole dumbass loser shithead prick imbecile cretin retard jerk wanker twat dickhead bitch douchebag dimwit halfwit fuckwit fucker motherfucker "
    "idiota imbecil imbécil connard abruti arschloch vollidiot wichser gilipollas cabron salaud".split()
)

EXAMPLES: tuple[tuple[str, str], ...] = tuple((t, k) for k, ts in (("abuse", ABUSE), ("hate", HATE), ("sexual", SEXUAL), ("", HARMLESS)) for t in ts)
