"""Words and phrases of abuse, hatred and sexual explicitness, and of contexts that only speak about them.

Fixed values.  They are here to be recognised; inflections are made from the stems by ``ENDINGS``.
"""

from __future__ import annotations

# Stems by category and weight, in English, German, French and Spanish.
STRONG_INSULTS = (
    "bastard bitch scumbag asshole arsehole cunt motherfucker fucker dickhead shithead wanker prick douchebag whore slut faggot retarded "
    "arschloch wichser hurensohn fotze missgeburt drecksau schlampe hure "
    "salaud salope connard connasse enculé ordure pute crétin "
    "cabrón gilipollas hijoputa puta zorra mierda pendejo maricón"
)
INSULTS = (
    "idiot moron imbecile cretin dimwit halfwit jackass loser jerk dunce dumbass liar clown pig scum vermin parasite savage subhuman filth brainless spineless repulsive pathetic crap "
    "dummkopf versager trottel depp vollidiot schwachkopf ungeziefer abschaum untermensch gesindel schwein fresse "
    "imbécile débile abruti gueule vermine racaille sauvage "
    "idiota imbécil estúpido escoria basura inútil alimaña"
)
MILD = (
    "stupid dumb worthless disgusting filthy dirty miserable useless lying garbage trash thief thieves damn rat rats hell senseless sick hate "
    "dumm dreckig blöd elend pauvre sale dégoûtant asqueroso sucio pedazo"
)
SEXUAL = (
    "porn porno blowjob handjob cumshot hardcore xxx horny busty milf deepthroat orgy fuck cock dick pussy tits screw masturbate "
    "ficken geil geile titten muschi nackte "
    "baiser bite chatte chaude chaudes nues follar polla coño desnudas calientes"
)
SUGGESTIVE = "nude naked nackt nackten sex sexy moaned thighs erect cam pics videos vidéos vídeos uncensored tonight singles clips girls gratis gratuites free nue desnuda"
VULGAR = "shit bullshit fucking scheiße verdammt merde putain joder"

#: Phrases that threaten, degrade or send away; a blank stands for up to two other words.
PHRASES = (
    "drop dead|dropped dead|crawl back under|make you bleed|find out where you live|watch your back|beat you|kill you|burn in hell|go to hell|shut up|get out of our|nobody wants you|nobody would miss you|you make me sick|i hope you die|"
    "deserve to live|deserve to die|driven out|get rid of every|get rid of them|kick them out|breed like|born thieves|not human|not welcome here|go back to where|wipe them out|exterminate them|"
    "halt die fresse|aus dem land gejagt|halt den mund|verpiss dich|fahr zur hölle|hau ab|sollen verschwinden|"
    "ferme ta gueule|espèce de|chasser du pays|va te faire|ta gueule|rentrez chez vous|"
    "cállate la boca|fuera del país|echarlos de|vete al infierno|hijo de puta|muérete"
)
SEXUAL_PHRASES = "had sex with|hand between her|between her thighs|hot girls|hot singles|nude pics|live on cam|free porn|frauen warten|filles nues|chicas desnudas"

#: Speaks to or of somebody present.
ADDRESS = "you your yourself yours u ya du dich dir dein deine euch tu toi te ton vous vos eres tú tienes author reviewer whoever honestly listen"
#: Peoples are spoken of as a whole.
GROUP = "all these those every they them are sind sont son les die los want"
#: Speaks about such words, or in a medical, technical or legal sense.
STUDY = (
    "study studies survey surveyed annotator annotators annotated labelled labeled rated ratings scale corpus term terms word words lexicon dictionary speech classifier dataset "
    "removed moderation law laws screening cancer education clinical patient patients dosage medical anatomy tissue species reproduction breeding bred animal animals "
    "supervision harassment category categories quoted quotation historical etymology definition means translated literature switch process algorithm systems zones equations solutions "
    "wort wörter begriff studie untersuchung mot mots étude terme palabra palabras término estudio"
)
ENDINGS = ("", "s", "e", "n", "en", "er", "es", "ed", "ing", "y")
