"""Hand-checked texts on which the probabilities of page quality are calibrated: (text, whether it is no prose).

Fixed values, written and labelled by hand; none is taken from a corpus."""

from __future__ import annotations

PAGES: tuple[tuple[str, bool], ...] = (
    ("The council met on Tuesday and agreed to repair the bridge before winter. Work began in October, although the stone had not yet arrived from the quarry.", False),
    ("She walked to the station every morning. The train was often late; nobody complained.\n\nIn the evening she wrote letters to her brother, who lived abroad and seldom answered.", False),
    ("THE OLD MILL WAS SOLD IN 1874 TO A BREWER FROM THE NEXT TOWN. HE TURNED THE UPPER FLOOR INTO A STORE AND LET THE REST DECAY.", False),
    ("The harbour was\nrebuilt after the\nstorm of 1902, when\nmost of the boats\nwere lost. A new\nwall was finished\nfour years later.", False),
    ("Le marché se tient le samedi devant l'église. On y vend du fromage, du vin et des légumes, mais peu de viande.", False),
    ("Die Kirche wurde im Jahr 1712 geweiht. Der Turm brannte zweimal ab, weil der Blitz ihn traf, und wurde jedes Mal höher gebaut.", False),
    ("El puente une los dos barrios de la ciudad. Fue construido en 1931 y todavía se usa, aunque los camiones ya no pueden cruzarlo.", False),
    ("Старый мост построен в 1820 году. Он находится у реки и долго не работал, но теперь открыт для путешественников.", False),
    ("図書館は町の中心に近い。古い橋は1911年の洪水で失われた、しかし港は今も使われている。", False),
    ("The report names three causes: poor drainage, old pipes and neglect.\n- pipes\n- drains\nAll of them had been known for years, and each had been described in detail by the engineer who left in spring.", False),
    ("Sample A4 was heated to 90 degrees for 12 minutes; sample B2 was not. Both lost about 3.5 percent of their weight, which the authors had not expected at all.", False),
    ("He asked, \"Where did they go?\" No one knew. It was past ten, the shop had closed and the street was empty except for a dog.", False),
    ("- pears\n- apples from the valley\n- two crates\n- rope, nails, glue\n- lamp oil\n- paper\n- ink and pens\n- bread", True),
    ("1. Introduction ........ 3\n2. Sources ............. 9\n3. Tables .............. 27\n4. Results ............. 41\nIndex .................. 60", True),
    ("Apples: 120\nPears: 88\nPlums: 17\nCherries: 301\nFigs: 4\nQuinces: 56\nGrapes: 77", True),
    ("year;town;crop;tons\n1901;Arle;wheat;120\n1902;Arle;rye;88\n1903;Boden;wheat;91\n1904;Boden;oats;17", True),
    ("Row   12.5   88   0.3   417\nCol   99.1   4    1.7   20\nSum   111.6  92   2.0   437\nAvg   55.8   46   1.0   218", True),
    ("2021-03-04 10:22 INFO worker.7 code=12 took=90ms\n2021-03-04 10:23 WARN worker.2 code=80 took=904ms\n2021-03-04 10:25 INFO worker.7 code=3 took=11ms", True),
    ("00000010  7f 45 4c 46 02 01 01 00 00 00 00 00 00 00 00 00\n00000020  03 00 3e 00 01 00 00 00 50 10 40 00 00 00 00 00", True),
    ("zqwk ptrn vvbx lkjhg ffdsq mnbvc xxzzl qwrtp plkmn bvcxz gfdsh jklmn\nwrtzp hgfds qqwrt mnbvc ytrwq lkjhp ghtrn vbnmk", True),
    ("Ã©tÃ© â€œcafÃ©â€ ï¿½ï¿½ Ã¼ber â€” Â Â naÃ¯ve ï¿½ Ã¶l Ã¤hn â€¦ Â§ ï¿½ï¿½ï¿½ Ã§a Ã± ï¿½", True),
    ("press start press start press start press start press start press start press start press start press start press start", True),
    ("The page could not be loaded. The page could not be loaded. The page could not be loaded. The page could not be loaded. The page could not be loaded. The page could not be loaded.", True),
    ("barley, mill stones, rope, tar barrels, sailcloth, anchors, iron bars, lamp glass, salt fish, candles, nails, wool sacks, copper kettles, hides, timber boards", True),
    ("Mary Oldfield\n12 Station Road\nBarton 44021\nPeter Quill\n7 Mill Lane\nArle 20017\nAnna Stern\n90 High Street\nBoden 31337", True),
    ("The prices follow.\nWheat, 12, 14, 19\nRye, 9, 9, 11\nOats, 7, 8, 8\nBarley, 10, 12, 12\nPeas, 22, 21, 25\nBeans, 18, 18, 17\nHops, 55, 61, 70", True),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBub3QgYSB0ZXh0IGJ1dA==kl29ZZplq8\nbG9uZyBsaW5lIG9mIGxldHRlcnMgYW5kIGRpZ2l0cyBmb3I=pp1Q0zzR", True),
    ("田書市南土運森小北場新港月河南空橋中山海図石台灯下川火東館古年上金木", True),
)
