"""Digests of full licence texts: SHA-256 of their canonical form (``license_digest``).

Made from published copies of the texts: the GNU licences, MPL, CC0, Apache, Artistic and
the University of California's BSD text as Debian ships them, the others as open-source
packages ship them.  A licence has several digests where copies differ in their heading
("MIT License", "The MIT License (MIT)", none), in "All rights reserved.", in the numbering
of clauses, in "holder" or "owner", in the address of the Free Software Foundation, in
whether the appendix on how to apply the licence follows, or where a wrapped example of
that appendix breaks before its copyright line.
"""

#: Licence to digests.
DIGESTS: dict[str, tuple[str, ...]] = {
    "0BSD": (
        "022907580a46ec8ab8af9b96a9effabd12e9496393f4f28b73daeb10bbea4d8b",
        "02528640a7e8eac670311d2924f9c2f81bec726e342bb1b3649777dcf6a2b3fa",
        "135f996b0799264a94667b307181b4e708ac75af3dd183e62a37bd0555cbf0cc",
        "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c",
        "2f0e9bd97d3840ad1794cac641471cf4d96238da7ce4079fc79a8d414f6e3920",
        "33ccc2d840a9938a4483b8a877fbf1d4b1489afb1342a3251de9049ef1610849",
        "35c04e36cbd561c5b426fab4e84812826ba04258dc2859f780241153dea18a30",
        "372b76fce8a85edada5ff175957c869e03c471d2001ee067e2835b7d9519d6c7",
        "465e457ac5fd235307823d8bbbb9056fd539963335b7d10cb19bacd5df3e100e",
        "53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe",
        "54643a31416c8580fedbfcb2a7715e66c400a262adcbad165fbe1c9671a3003c",
        "5e19b64a719ef9785b8a1f6a2f174eb20769fa2d1721c9a7c5094bfa077cbe37",
        "6820e47cea55bb970e15bee1f23b10bef25138068783973d0c26849437cd5a70",
        "7e7ac98a1679b2877c7432da0d2a3796ef214aefad9c1fd46ed8b418de1d5c45",
        "843df9be100ab21a2776200c2594361c829160bb555f44ab1bcdc07b87066bee",
        "85f3b8fff5025fd942abd8283362ba75bb6d7b9bb43b6168789588e4beed7bc5",
        "9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153",
    ),
    "Apache-2.0": (
        "296a35b4f3b6a7e90a68c08362fc50009807cd0dfd4f78f36f4062bd4d202555",
        "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a",
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ),
    "Artistic-1.0-Perl": (
        "973421bbd142787376f61e4425241a4c9066b8d204c34b405450899cf7400cb1",
    ),
    "BSD-2-Clause": (
        "0260b47d63f00fe2e725799e7c10e2a257e642533fe179ebafe22a61e15cc251",
        "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69",
        "0558f2532c8adf727a6ea94e05f67334c21e5a2b0b7f854ae673e87cdbc5c300",
        "060283608934574f83841260492ea4efb666b0c378fa290d9366723fdcf5f2dd",
        "07009138c2c60079b5c0af517b8bd8b4b42ffc843cc131a20d92d08a8f23f9fd",
        "09ac8aef03b534b49f2f8e488dcfd3b52070a451edcf461a40078e9a260950a7",
        "0c666ab40d95e8e1b4b0de785a858bcb3ef1c1e241b5b1b70c5a8b7383d3fb36",
        "0d2a68fe30f63d5ed180e57170b287823af9c469adbc19afc90bfe7b3ba9c7be",
        "0d590d3d800dc86d159e25696bbbfaaf38c62fd3fe8b88268d5d2b1c58f40a60",
        "1004f5fd140389f98d6c00b0a36b557171278187759bbafe288fc58e8ec95761",
        "107f999e5ebfcc4da4a2e26431c3125ba7e343557937432223388545d4add2d6",
        "113e6853140f7f93ae6e25cee2732a3960f41002a8f86a884b35c85cdc3877e0",
        "11480daa598529ee4b61b822259e07a574bcd8f43220f1accfaff1c2a89f9b3e",
        "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe",
        "1229cbfa6d5525069fdf9c602ccfcef96ea383943e471e63e9ff018e2564fd6c",
        "143e302a45a79647d316b211bd39569695ab5b26346d64f031e6829f4bc21840",
        "1466885ffa4d1d40f2787ed66595b134c78efb548ae44a3cb25562cb64bb4106",
        "1717ff2b1e6acb44b4bb425448cac8096179fd05f0d9ea5a622a60d9409d56fb",
        "174d5be79da3a0bcf9b4ee126dcb3e5ae34342f63d00de7a4cd266cfd339fb82",
        "1836ea3a792d40d06ea0eb2ef6d305c909c63acae2b28e58f7bf503737b56113",
        "1c4069078adc3391ce106e3b547135874c5466c1611d59ff0d1a451da55cfc03",
        "1e8beb20e5d244cde2ddfbfff79d49700819c27986edd8a17f43d1f6a19c60cb",
        "1f1bad48f170b0f54e9a7a1138cc513382aeb7674949f2967a3ee7f3e40a3593",
        "210ec26459aab08f86ab89dae304d42031b2e7cbc36fa98283cc80f7510e51ce",
        "218f5b650f149e23f159537f8b1ab16d0ff44722e0038a34bb90a58b3442864a",
        "22a603ae7ca12ed32433ab981867da4735f74eae59e3da680b1fae36412f6288",
        "230d706231aaf2dc4fe5607896a4cb042be171c3b583b0a198a658a112c15c75",
        "233ca820eaa26c5c917e9273fcec13b65a3c34d74cdeeec5de1f12332252957e",
        "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1",
        "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2",
        "23e2fae91907550606ee3f56c74f218570ba4bcf2e454790b10eaf61177c765c",
        "24045fb62df80e26883a6dcf02010bb29b5639b4b4b82816e7482dc4499288a4",
        "25cb6047393718ec74a0d03736e1fb88f936acdaa2dbd2472d2c851c4c44431b",
        "264c6e7a423ed577be25f1127d49f888c4185589144914b8cb1323d4db8be121",
        "2745cc0a63b844cf79449cfeb9dbecb681f38d964a1341225821c2b2e836d0d0",
        "296df3eb29c9faf9d82ad0bcb0e833dbfedf2ee4c72114aa7699271421eb1a58",
        "29f81ea28dcc771a4c97ea7530094aca4fb11ea8d52c81969e700b337e95170c",
        "2aa3b5bb44b3244043f2daa9e614025c04fd0919a12df46a7016d12248a72f91",
        "2bbe1638c7a6f76c36f79582146b108b4b5e8ccc26b0fbc25f3e6fd6bed52e5d",
        "2bfab67fd08a288050e6f725dc171b3e356dc50a4b04b23b6d5e27b6fe7ff639",
        "2d0192e2a2ca66257f716aa182dbe00a2b4ddd122d41cf25d3682bd84b980bc5",
        "2d43d7fea89b3633b95184ddd4e7d55c0d384cc18515de6da01adef25b3a8439",
        "2dc7381283882b4b48a392e9651a01b0ad5e8baf330ba1752d4c2c48a7ea82f1",
        "2e676f1581414ac57870f6bba4ad61786600bf89cf37badbeae10a3c7251e0e6",
        "321f8782a4c29e9ea49876743c9049bf1f187c6d07fda251f000e96f4f2ee8b7",
        "3299e7dbd102b19f2e78ff8c7e46f3f1a75ab72655e7c599f6f26552b6fe5cbb",
        "351848f06955bdd799e7b3b0879ea0d730fe52d4cc9a1c1d02f1b5477247b393",
        "370ddf1b4392d5e953aac40a1f44a0f2ed40a145aa8c3ac456be7e10f2eed524",
        "3851d34d50dcbb9256e3af58b5c99e83430619b6380f4adc9b118e7abf80bce6",
        "3875d99ba80fca67ef9b6fc24a9542b32698b801c5b310261aaecd5475a7f9d2",
        "3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5",
        "39a218d326b053017477f11ba35cee9d26fdac59f5656824e14e35aad6ac5ace",
        "39bf1f2d26ae8c366dc83591039be7f0d61a26df3e0791f80c2e7dea787c89cb",
        "39c9e16877b63be95a6bdbdcb94e74dc2cf345092c76593c68f7bbbf27253cb6",
        "3a9cf7a5ffad41e7b383cdfb9544d12ec6645bd25cb352d1f1fe18c054715adc",
        "3bfd9198f5991d5d8da663ed75280215ef471c1c132829fc0bd9dc25b27a7d2c",
        "3df2021da9f32fadfca805b31ef1c7b64be859e99cd20894eb08aa3615d7232f",
        "40c90f6c9238d3566db0815d918a429881073d60e82c7bec1eb0155a8913d98c",
        "41fdd7155420cea855884520a49ebb1ac26414020894a8a2bf02bf4500c0cc26",
        "4383e33424fc6aa46640f80aec019015d6f40e9da46cef735cb4c8a917c63da1",
        "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2",
        "4628171d2fcf4196f6de09a1c13d8e85ee89ae95829138cb76be11f8a9e69e08",
        "49974759e54104abeb2638ca4fc098f7414a083f291099d8f783ab02ed0be923",
        "4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a",
        "4b53b6b4354ca4168de01fcf01795620496ab735a3e264e5a2d7453c76791d1a",
        "4e2dafe0dbd2891d84a25995ad0186c629e9787b2867f0a8e5dfa3c2045acc36",
        "4e5d4f4f6eabf2e1c562bd09245ae6294ca7bbd317edad0f1d55aab3fbdd72e7",
        "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374",
        "522ca21da6c91f518da5deae481d3ef6f116d24b0e8c08390bb4d1fd1ee3bc9c",
        "53935ce163edf77d7e4caa083973cb47826ff061739a1d72e6dd136931786998",
        "54018b9c580f2cc99cfe7e106216210f3ff9451599f0611653cce57a953e097d",
        "54795411a199e786c064fccbd472c5b4de39729098e9e3d06904bc32be6d9650",
        "55e92b12bc095e8bacd58233717004c0f06973462fd6d9c5401b5c90fbb7539c",
        "5708ba7b961068f2c6d9500fc0d77f8c66cf2d7e438289dfbd1bd5e7c00b80df",
        "571af178a71850d8fd151bba5e5428a46ae60772cd5751f5f3d0681c1e30e45c",
        "57ae078c38de203267feaeb25a39539084a3dc68016762ffdb9e30341f6afa5a",
        "585240d7c7448749ad4ddd9ffda3804ca9af5eaa926cf9ac2c4be73d137aad86",
        "58edc1c6fe13a02e7a61d1c6e8f2f3212b85a25467c3e6cbd382a64a564fa874",
        "5b31a59e1f4fc0010d4213f4728111d521ef1ff2792c5b5cf68f7b96785b548a",
        "5b465b5458b89529218996fc0a4e089f50c3f46e67121fd163e809591b7bd816",
        "5b8ef1c1a86008deb8370ff91f82a060f4f2038a2a4c3ebefb56a2e9bd71ad91",
        "5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424",
        "60f16c0da00f56775f1c3d6f9311b0e5f29ed6dd2f77116f234901743ce04e48",
        "61d8a7b183104402625ed9e0a53a57806c06c36c4e8e4c9815cbb42cc1d5cff0",
        "63151a500234e07ef3e50814b0d1d07db92c9481191003b577fbf42336ed40a0",
        "63a8888cb41e8452fcb33d41baaa08d9c4d77ed91eef7ca7f6d5b9f6f4a89696",
        "644ab4ad5c9211bc29ab7abfc4274a3430ab5571b1522098c0ab1bbd62f3b815",
        "65d4e662e9a27f360c53c5b4a053ad317138f6f2ad398aea68587a51278009d0",
        "6856434b966316a2e510efb2e71f3be26dec8ff7e035b470ff0cbdbdce34e9ac",
        "68a0ccf3e314ef297ac9f4a142b7a062ce38dacefbd61841db6a8223a82c00fa",
        "68f54bd97d77aa7c6d7a3706ff20555e202ff9393a9e5eaf4f0ebede2ff51a1f",
        "69cdbd21a2d990e706160e435568bdf1c22727c4ed2cab0cfaa1b78b3904ced3",
        "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9",
        "6b5d123c4e3497cba88844d845ccce94cdc9289a67dc4f061541c717d83fd85c",
        "6cc862c1f361bc6eecca63caf3b4ec6670825d4917e73700c8557ea444b19e48",
        "6e6af5c4dc5cf8324bfc456da10b86a5c79241528ee3a0f84b73257ea213d1b8",
        "6e7a812c94c21565e57090a9d12200f36dbcf7537bf22ee860a7c3bc8a112122",
        "72043205515b5721e0a312ad412080d2c3d293420ad4d3fa33da598806a9dc2f",
        "72ad5e9ff5dc473600726a1e54367c45514b6abb8cad383ef038623240b347f8",
        "72c7b289ff04447798ffc634100a46b35184d93e0fd022f4ff6bdf17d66c2f9d",
        "7412f7ee502b0e1eddedab2fd96afa36a9b61c563743d2d8318ad5e460bc3264",
        "743b012943e2b65ac25f52e7dce7d4bcae412e950ab585d54ec742b0c52067af",
        "754bc1ec9f626d073526a7079f66dd38cd91ff4ea3b8766a05f32a698f64d9e7",
        "757641796f5809a5392a06e2ef8ece61190856ca9b6456d50797d190a665d54b",
        "759fbc88d1a61bf63640c42d23a213634de667f3d7ae64bc844d566a6cb7dd57",
        "7aef9af6c782d3654a8b17fa1a284d2518e56b8d44b5ebff8c73660b00a3686e",
        "7b3eef09e6035e91a3fad2780020402529d2535b3539a40e6a7e4c550e978cce",
        "7b4865c7c1bacfdeafd2966447594f21871cbe2b5848b5b8f8c1e13dd286ef2a",
        "7b6209426baeafab65ebc8c69c238b0df671f49ad7e9e476f13e74b10cd9a01f",
        "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2",
        "7c17f7d8be10ac278faa6acc9608592c5d9a23edb2d500cf4989bba72df538a3",
        "7c37d31c659b5b27892d66ad6ef68598af2a48bca290f0a9a650944f5cb9128b",
        "7e4c5e4b1c33d8553fd28bdbce45b31a1c4b8be08c0f1515799735b88accee2b",
        "7f95da13444a9a910b4f7fefbd81c8a1a6b59124899aa16d19d9ca717bb5e26d",
        "7fd217a525a12bbe0dd20abe5353c49df66a514d8b8f2cdd31fd31305af54138",
        "7ff364231b3920929bc5aeb795343ae30f2aea77866054735ecb69e0e70f55b6",
        "81ee6cbd7db7920deb1bc485d7b578850bbd15705cee5809b02845d1456738b6",
        "82d8742251e93f665166f1c5dccb2e83e2ec11a1e4f800b30cc65b709a0a712f",
        "84ecc15bfa932d0d52bf048932e7161daefdc5fc7a70bbc46062407f0ac13cfe",
        "8552c2febffe23157262177f2fae18721e08a51aa38203dd2b05f883faeaafe7",
        "85b4e5f84a49be2c956e295ef3eb7be6d41833526b71640c432e94bc4157f8b7",
        "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221",
        "87162bdff6a68b800abbb0e3b9d839a115808ee7abd4c233cb29514d9985acf8",
        "8834af0c73ed33b37877c9802e794cc5ada000b26e9d35a3bc44759cb74087a7",
        "8906363799dbe7a6aff07f665d7698ad3e34b029f09df3d473bf1118a17a2f1f",
        "896f2f9dc40c4a94c9b3998265c282384c6179d56a098dd2a33ae96dfccdddc7",
        "8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453",
        "8c578795c7eaefda33b03bcd1b5617be4f3266067b6f02a35de87c3951efe8e2",
        "8cded5337f27a6275872fd21d6fdf5eaf2c4e9aea6bdb60699ce119b22da1bc9",
        "8d99014d2d2b930e81fa6b7d027fca173a77fa8e42f8b10eae0e8ed86347b4fc",
        "9065833a6eaafa5a9c5469b09a210e06f425c9bd898ba15ba1282ba620445276",
        "91baa98c3bf32e296ea38e69f0d90e2f088807952fb4532da699f04b34a43c63",
        "924d7b4712c0ba842b8f5b9692c7adfa271df78cc792e37f12931127c292bdab",
        "9453d11b6046de6b09039d6c5ff802e0b41209325fba2f4175f2689d1e8a33a4",
        "955f580fb4403739639beb07585e33d60a12c12ed8aae7fce6e2a1262fc7f8d6",
        "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd",
        "978c7a0959159e12e72bb9af7a8f7f2ba5bf503fa86cca51bc880a09fe62789b",
        "97b85d03045dcf4c4e838c7df96e48bc78da1fa70e8e8b739d2c704c9fcff0c1",
        "982589ab4ef486a958cd7491482ccd8c49f9642dbec1ec15dc8c42fb34e1be4f",
        "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74",
        "9b649780adb788f44a5e2b5a4ce604a105709da90d15244b5fe1243fcfc5765b",
        "9c47a682ef64c4e02c50c208384916c7f80087d4e4395b2b06e65a4c4b08b152",
        "9e1e438b66c2a86524cfc461d2a5eebd394b0a5f7d215445d0865050a40aaee7",
        "9fc99845855bcd56484ad790ae38ba157500f33df78f52994689e2db28f95d14",
        "a106c0e2bce141ab44a2b175cf75bea1cd380748fec8474f93621867ef092fea",
        "a11471bc40750a21bd4508891b5626642657a09eaa0ef1ec576be7d37fe5ada8",
        "a22a1b1fd2de7816d322e7e5704778af52b1861158deb8a3cc441af54046dc0f",
        "a3bead76df5f8284d9483fa7a384911998a49713991c5ccdbb01b854c54e33a3",
        "a3cfe4e49a3dfd081fd416c373053501e62bf45211c90def39e1a4e78f4b8943",
        "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30",
        "a78184b2c67ed3906485a7e9161d724c95e04261082e06a27869e1753384b18c",
        "a973dee5884cded418aac1f6a1c8735c99ec89b34c9b81298a14fb1d98b1ab1b",
        "ab5d803e38ad314cab46e5a13f5d53ca09a830c2e355f229f0eb73d6623225a6",
        "add68477e31f4c39352b96a5ed22128c47aa7c46de62e8bac51e8b390c6b215c",
        "afc2264b621f53a826614827e341a654bd06f107fb2e274cc48178791f56058a",
        "b070fd5d70d88d2dc201bf62e27cd5c1a36261a7b51912e5e4f044a2081fc2be",
        "b21fca8ef7539f3414c6ab1868453ce9f21d1e3411439919aba9f7496a16a404",
        "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893",
        "b27ae1244cfe7ac22545c64d69df9d6f21fefc643e67fffab979dcb62c1df56b",
        "b2d5b9abc34503c913463164e4ad5bc26a7f89074c34f4a44bd0b8175d00b04f",
        "b58691fa4256545304e8772d68ecd8e401ad67c1cfed4530e01c59bbb34c642d",
        "b5c3c0b2da687704939403e9641bfa71f9734f25c59b18f573b353a0f58cd0a2",
        "b76f6140ec177e5e308179428dd43ca31853af2e27341c6a325ce61c28b0b42b",
        "b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233",
        "b851986ba2da6a30b12447cb3be23018b3b66b382c2f5ae0a9374ca57a089abe",
        "b9578a124b7f83b06b28da656e009d5188b5c664c402b7c018c56cfaeb24b00a",
        "bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07",
        "bf329b8434c17e88ec67c830ae6c179b1de6dd60c1a1459514cf6badb3ebf90a",
        "bf4cd629bb8a70e349537e8ca530dc88576938ec375a2ede8054a0ebaf7ae836",
        "c00a43eb6d728d9645e111b3197825216bed90e1fbab33a298b6a074f742cd28",
        "c0337f4d7b3d2534dd8c4cb1a8da7ae9a2175f0762806f16280e068db335e28e",
        "c0ff55161e65f7f3f0619e82a14fd57045784f70a459fa8db577c49c613b945c",
        "c57c1f6786157044e76b8322e548917cedb85998833d3edc08230d44bbef3bd0",
        "c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24",
        "c94b358453254f7f4d637e2f6da3eb3c98b9bef523c64a4e9becc1a1e493bdd6",
        "cb19805eac283bd8cea786373cc0e19cabbf15bc4cbd572dc1efb3dbd05ca91d",
        "cc8fb75ca08d1aeadf820aec5a627baf700b9606abfee3500d857d49648cc631",
        "cd1543bc0a9a5ff9dd15820eec2f3bde2ff3df2d0039f8f95f7c2adc40ebecbf",
        "cd21535c04fe93c958547552fa29955a0b6793f8ec868f8a685d83b94b38c855",
        "ce3f0a8e9fa3db74241bbf21fbb5d01b5f822445b47b56fd432dcfb5128c2bea",
        "cefc40d2d00fbdd4a2132b85fb34abb2655722483d69cfe7fa7ac321751851c8",
        "cf4072f707b1cd15fbb9ba979ea91f667f0e65791c14e9d568da0931a549328d",
        "cfad2e71be3807ab417bdac377d186402118175e5b248884676cd76970b68bd7",
        "d1896e1640eca4959ae63e6b846aba6494d53f8aad7ea51c1be604bec7818a02",
        "d1ddd042d491d0c99c0140346bd011946ba07544624061d3ea3c492be8d20dce",
        "d7dae9451df2ea86220bb7b5239331d5085edda0e7efb3e1fcb9613952f1036b",
        "d8273d18414549823077df21707b29ce7fb0661f8dd82fdb4b3632c3d07901fe",
        "d873404919cbc71e0a715d0f2bd267ca90c83465f70b71f472cd8bdf28e56585",
        "d8c97cf1bd233e0badaa205e1bd0df011786acfe71eb21b570bdf84082105cfb",
        "d9360b475bb35dc9bce111eec4d3be1faa67ed2a3a561f03ad44e73b4993919a",
        "d96fb60b25875276665fd8abb6039ab32e3daf8224c7d06f51f60d74acb74bec",
        "db07e60b884ead81df23739c2c467c6b9fb8aca0d485806a4a2765f14b752f3b",
        "dc7312357e34173d118852bb7da6423d8e970b37c39c23b1d486f25e9bf1d950",
        "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642",
        "dfb7f83d6813a938536e1fa45d26bd78a58f06fa29d431a1d8cdab77afdfac96",
        "e05d4442cbb8a4ad92ff698ac2d7c6b95a937ca7cf59a5c6c29fb28e69f60156",
        "e110bbc54ed367fd34fb9da0b33d627107c446a4c3d3e1c19a7491e69e0dde81",
        "e3343a575c14cdb50aabebd57ea2d515005f3de13dfaed1bb528ad24cd90fcf2",
        "e5bd5cbebbacc4d16f7e4ff678566fe7145b164f409456ce9afb32270b214d50",
        "e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9",
        "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9",
        "e965bfe15cdcf092706da02c38cbf69ef02a729b58c76bb3557eec7c8c198a59",
        "e9ae5cb468a235e28a247570942c0f7df58517d87bc56fba4c77559babc92700",
        "ea3188977a23248d4db39192630016a8f33f74f65331694f9a3678a45738ec0e",
        "ea82ee94a10c8bfe64b6cff4f2412678ba0d613f4525fd4011130d1ea139ab99",
        "ea9851b8016ac74ce446b98a756b7299db556d303b20d7a55ace978a9c835820",
        "ec53c5aba836a6f81d55363c0339a11b270de1b5794781a434470de13f0a47f8",
        "ed949136fc10757bb6ab8e9f4843d76fd1ed1afc895127a1ff833a9b3bd38bd8",
        "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc",
        "eddcfdfb771f61c172f95c7ecd254d9c71d0a17a25bd31d82a815e6dfed10825",
        "eeeab62073b3da0ab717a6045fd4653c095ff95c819a028b297cbf4a025125f3",
        "eef451bacbdfdb7b5e3ebc8594e5a452bec13c11d3bd6763bce53623bc9b1fa4",
        "ef3398d938fd4b209c8dd746bdc5ba396962332ae151500a4bf196e5f02e24a7",
        "ef3c818b28792f48774a4d16b461004c5e21338f9f74f2664f41f86803c30d60",
        "f12994e03bd5c0c39a53247b091a1066818635f9b776c60626bcfae4babf953f",
        "f1a4f1ed7bffee0547f2484f7a533a60b2388ca88b29a916ac0e448d085f2db6",
        "f2880916b3d6495e16c498bb5112370fb0faf601ae0004de593342ae37a13328",
        "f2b5ed40b916b7b1788d4f6de9b500289215793e5ebd8a1469227bbda6099ea9",
        "f352cef1fc3f8db1f8b0331dde3b202575711873bb2ff51cb5220337efabdedf",
        "f38fa2034bf54944a35dd1ff3703481e42a97c80896b1db58621ba8ec98c2048",
        "f4befedc01589c90d5effeae5f64453726c8fded8e4b6fe6c36f99d303581f1f",
        "f53ace95bc136ae3cf896faf460a72e380eaf7a425c46ccfc19afb24e017a846",
        "f7bc0568e70cf926a668f2cb27789f6efb760139a9fdb4b5b75436e2cd954d08",
        "f91af8cd638dd4e4eef00aa728e6d196e5858913d92732fe425edbd59fba0357",
        "f991952b9964ebb795b767653dc7cf7d056ca2529e9434d77a78006de0b7a468",
        "f9a01822d356fd20251d8d63103bc303535cf29b9f2697d86064c03191dd85cd",
        "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b",
        "fd076632c58190e9442f5a6b9433cfa1b09287bcb70759381a36b536a5cca47c",
        "fece88b55720c03eab4a325630de945651f3fa68c972d2ba0021a327ece6451d",
        "ffa754873c41d90555a063155f2480774210362f654be12e178a3a313002cf3d",
    ),
    "BSD-3-Clause": (
        "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523",
        "008d2354d2523bbff61f56d777bf3648ca9d86c53467953eb78bab5c6911564e",
        "00b948dd98892624c357472da6d4ac0e01641235c0d20eacc19c698b3994147c",
        "012231a5abe8f59dfbb97d4d3019267148f5214f1e68f2a937670f3ab76ffd2b",
        "012ad388f35541518988bad0e6a944af3db0b25e10c2392a59010f63fc50af5f",
        "02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e",
        "036c2f1ba8865c7d5573815480b26bb66aa4dc00d13c7a81e2caef0529b416c2",
        "045213514488c92224ddc07da13f7af2287cdc2206365508420c5f071ecc2a6b",
        "056d922fd7e56a94597a5d5a78c62c9b3b4dd3aade18424db7d3a4bc40fbd381",
        "07002ede2e559c6e97a5ba89a53d7ded83eda46c54cea64eb39745675c2aabfc",
        "078ec103be24d8accd6dfa07a553735830389f48ce7fdd945dfe7d2b8f18d557",
        "07fa613ee77ec4dfbe96ee414cf591025f20eb972b5b8b314910046f06ec3fbe",
        "08555728b04f2538364bdad6efe1eae45d2eadd7080d7534503aa87aaad1e384",
        "08d374123387c1cdc5612ece7e86ab1b23b23f2014d5f32caab2857aa6d7862a",
        "0903be115ec96d6904c9927169dfdf48bd6e0547a5da37e387b54e230f5c7cf9",
        "0a89a53f809c37a26317f7b61fea1a922d32dbadd7e93d23a00f49a9b6cdca3b",
        "0bc951bde8c4b5f247ac086924a10db20d792347b12dfdf4a88c68c7241036ef",
        "0c5a5ef4744de29c6790a4ab09ff1ddeca72550165c5b4f29a936a0f76f118ad",
        "0e97edadb8c3d41ff86c478514f6402a611421af53f51348f414293824ebf1b3",
        "0ef40c80feee8b62bf92d2c51ccd82ec5e211aef9dec65542a4df1089ab38af4",
        "0f4b00e6a717888a6af01dee97d72faf0f967aca58d345a5bc57dce7f9c4e399",
        "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d",
        "0fd715971b9eef40682d457e9b18f9eb0bdde1b640847b28593e4094f8871915",
        "1083b3b6c002ef4723d7d996a907773dcfdacc3cfa98440067f0cfb0ccbf360b",
        "11f07941a50f43321f2718632a3f0ec1e8d99f6644ba98dcec22748718baedaa",
        "11f8b389e6c789eecd73e37f356f2ee6ab902b506be10719957a3b52a20e41c3",
        "11fb98adf1b2b9c2a50afde7b2939a20b3977ce562aa50761800c325d39801e5",
        "121993ffa9554f45bf280b8f70d76d5cd6ba7afee6237af185c0d98c03da7bc0",
        "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e",
        "12ad40f598b7055f094edeadbb626a55903fbf3e2d4956a602548422d87ec5e1",
        "1316957fecb9b449fb1136e3509bd6a15c7572c8e74da9c814074438e5f572a4",
        "13dc6da36695efeab92d86655a384520c3cec8b0a6d364c7f69202d58ab9ec51",
        "14443f63ecdc64beb992a511cc78ca60e01005ca0dba7489b9e3619c658454d1",
        "1480e2b5ada27d273e9b263f53cfbefd68bc937ff176db10279eac5a93674cc8",
        "148896a7bbfdc6ea1618262d38e33bc5aa81d42c7ca119304f99697f2f78476d",
        "14c74613c04ea95836287e807ac4917f2ed4c10d2e06252eb8e6db7fe57926af",
        "15e36b5e87f0df3b30d597270febafd0d7dddca84d6456673d1a8c1c73fb6190",
        "160d9fa806e7c2fd566e0e74c3425e977f4eddba7741420775cc86c84a766dd7",
        "178dd57eaa89ef2df82b5d16677c7cc7c5a3508be5df924353491c6f40896b5b",
        "17e659f62742900d3b14a2bdbdf9d1f07cb3315900ac54f7dc3fb36bae0ac314",
        "189c3227b3453c9b65fceda8658fa77fe183c162184e1001de53b798c4683e00",
        "18b5909ada342bcfb88dd7d7ab950f0244fe51f3741345f315d6f927cb718316",
        "18e61a3e4100c9060b3d883283248338c2566a430ff764d625634185acd1a2a1",
        "1973699c52deb66fd60e180135c1d8534392b8360093ea7555eaeafbc46c0f65",
        "198f826063008ece2cfc642c2b52f947c6002210c965eaa3a019ac0efd7793cb",
        "19a4781693c27171941c3997100df63b3707e99f2135091c98fb3aba3429a921",
        "1a270c44d576f9a3b0db4cb35f5d4b18ac409cb271b91e4b5990e869f8a2b2ed",
        "1aa072d373956f3e4af40442bd9be9dd75bb300b966dd46ff926af0bd6f9afa9",
        "1aae4abde11eb57ed1fa1bc5b517397c92e7c08122744ac960713bc86f8e011f",
        "1d0d46d3c42cd2c93d2f76a4dfc6740df2448bd748caac45225bc7ca3f041925",
        "1d55e61cb529bc09ef6a305a02863df2b27833d3a22cbb7dc16d330d70f309ce",
        "1e350dc6c2d8da7bca0156ae532678cbfb4baa698831489ad313d2783a9635fa",
        "20c08a976d3f19d0a4e150c446a440af0875e0a8942a6dfc96522f8b566b68d6",
        "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997",
        "2195d9094c9e00622fbcd13a8a4b206b73e8f27d3c56453cac8fc067fd14cdf5",
        "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b",
        "21a602e16031a5098dd4d7263e9c2367b08ad55ff18882c0b8d529f14584743c",
        "21c4d607cf3e0a3fc959cda56ba52ef8f3215cef6dd4bdc5465fff0d366aa1d9",
        "222a68d2c48d4c542ff437b61dec69b7a9fa8905ee91b4fca0410d44576d8802",
        "23587406d8c14ade2e23bee516e3a74dfd796278e1f1b5b9286aa4b12243d27a",
        "2380c5e7288b984fa85d8f689b0f9549501de4264b3c6274d03407fa6ca5a545",
        "2400a1ff6b0405f5ee72f1ca7bb2d512c26044eae39eb3be72efacde83c757e1",
        "25c16820f3a5dd1a2e12af4846e4bbf1006fc340ac54dd44154d882534d117a6",
        "25e5e74309e0efdd9b106fc1909642324a2c7fd8f0bad6287724b624ce980280",
        "26908d18baf434fdf7814c280fb2993fd0b6d899a64ff457a313bb68f6f75cc1",
        "26d2ccddd54e5da4f3d32016fbb7d0633b383cb003ef0b936e1b5bcae6cb937c",
        "271375fc34d3f79c66feb9ddc2b82ae80423a5d2bd3e72e1ee3b4a1f05b03d70",
        "27a2e1e89e7112620faea164ab107b2aa62736c29f8447674a19f27a4b44d972",
        "27a864906b27c5837aa0d86b5d8fb8b42f98673c325f2bbf1ae631dff8380ebc",
        "28553719e8852ea1f16a4edee93594fc0e328242515e5582f6815422513f7429",
        "290390520606161768ce5c07868d47c6df0fe7e0b28f159cab7e4ec4560b1df9",
        "29b285a8395cef1e950056910da319ac46a13f251108cdcd25f30bbca65384aa",
        "2a4386d4ecdb97d143f06b73903fc9ff8f6c02d18e34a454e12468669d45c531",
        "2b526374754945dd7398d76115f8bbc319ae4f7761d6ae00cb80d67d2340cab6",
        "2bf7d7c3cbf27b63ce77a1e3618973267e215d55c2517adf75d13ce2ab0d1c60",
        "2c707e3827c9a6950485b5466a97f6c97b31f795de16fac0a5899e15f9575669",
        "2df8e09c09603c9a49b4dcbab5b66e2c713851829344c04b96531a1fa72f858a",
        "2eb3ed4894e52f9ec1e4a2824d33032bf8dd6df23538f674209da79b898a9fa7",
        "2f6fb974df263a2bb1bb74c41b0d4bd83f16d3f9235478e5a269330225535feb",
        "2fd546d4caad27458a27f5ceaefd41dbad8d307a82af4fffa846af810c43f7bd",
        "306e378055ccd2e357eb635ff8e2f5d78a6db439fb2277d6479f9d41c64a9751",
        "3167ec766a34f6e3581c75d3883bca363666b583bac1861129b938db0a4454f0",
        "31af89d2d1570c9170a28796d0d3fe8ebf2ecb49cb53f55b927c1ccb950cf802",
        "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903",
        "32cb6acbc2557b25f5a3913636a68a7fb9472295d0ba9ddf330c6bfa877d7c88",
        "3371befe47d51b1799737ebb533173e24a4ac76754188d8e8e8cf4721b80bb00",
        "33aaf48a1bc03ef399d5b9c0fc83f491c4104c082f5234085e033b8a7d558c26",
        "33bb6300f08466dc774035149f950bc53f430f73f74deb91bfe11f5d30e85734",
        "345640114867af036a3aa7e243af687e1c8a9201abf8d2b5de4991564794292b",
        "348bcee73af9403f3c445d11b325609ac570973595d923620ba3c7656c86f5d5",
        "348daaa54cca85e4244c864bb00e0f61934e7873062275bcc556f83233aea3d5",
        "34cd31dda6bfd23405aab772203fe400269b8e9ef564bff791d555d632a52f9b",
        "34d0057c4e053d058c95630340c71d701a013391be7abca5148e0d0ab75cbb5c",
        "36c20fcc08a5b633dfb067ce00dadeee4c56d6c85f493b875ff78ed554bae49d",
        "36d875eae87fecde5e6e6bc30250a28451c5f419d54b1963ef90d213b1ac9a08",
        "36fdcbfc8124635e7071d0ed2271bd9cac0cf975002801d50571c15dd8465554",
        "376d1d4634f050eeb310ede85f69914107cc498745bab39b4f7a52998758c999",
        "377726481bef4f0dba42ecf4baff35d1dcd2781e0a133a4f34251a898502e95e",
        "3883b9722205f86664288006989b724c66e8568e3cc2e722a1c9dca68ad70cea",
        "38ffde0f12210a2150d1ea1d05287e9b08c64028e69972d38c40799dac6cf92e",
        "3902bfd00024ed49868d07bdc2df6ad7030ba61c8e1377ec73293acd26c57af4",
        "39bc19d2e32c4824fe446a931672e4ee8ceee7bf191f76bf6c99140b01c64550",
        "3b05dcdda8ec36ab2f62a8ed39e540d48b8f889a83809b59bbeecbf050a83de0",
        "3b9e295ce0336d879d6d108925485a5a2988c528316d92e70fd822c8f9e9247f",
        "3c898a42ae652c0cbecf96fc066d640488d33514630fff4141470cf7e6ca6e3c",
        "3cd300f959396fb419a49ea8deefa99faf662bb3fbc2f80688f02eb23ba60ab0",
        "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9",
        "3d1e0a93ede7e314ffaa4cd34a45176ebc77d708396b93dded86f62fac1ed443",
        "3e3d12ae188f09f8972729d270ec76abf0be05627b3b9fc900cf97390dfbe0e7",
        "3e3f3d517e12134b1cfef8ccd59aacbcba29b8e6671f28545110c1e6dad08807",
        "3f15e7a0bba4a1d71c17597b43ca703ecf8c8336bf497df30a5e72f2340713f3",
        "3f4ae994de91ac1b7ca3518dc69779f79ee6efe96c5fd6436b6d79ef951954b6",
        "3f60f0cdf78f0a92c80fac67aa6cd8641363b5b786d18f78a1122a6db9a6b96b",
        "3f7da2d98967f0a2534fb1b5a8c5a41130a630242b7bc47903e1ea032a03902e",
        "3f9fda3a38ba2a10f3cd564cdc6050850df3134a4134b62ec47ee467ea84fd73",
        "40895433740a5e8d8948dfe207a577a94b73bf98abeabb87ac9dc6d7d0568593",
        "40a29e4fb9d60dd93516259f3df47d0378a8029859c46abe797995a66630c3f9",
        "4117ec7b57801506994e7b85ee1bc425c4573d0e75ab86ca680448b2f7ed5ac2",
        "4375b0861b35e0c61aa5d0473e393bace9d926c272224252ac80df838d93c64b",
        "43c97503385edad686e3aeb45913ff5a7d43416297d10daee1bb95a775bb7b95",
        "43ee82bc7175a779aa40c04a75ac7c4c8a096d515dc49fe0659f19f6a02dc573",
        "45372bca7c637a66663f9235f699b757033f4551f2ccb773484bd3ff172652a0",
        "467ed01214ca53f639510ba1c07ebaa9f8da4d7b4f9c22fb5f6b5692fd7d8b7f",
        "47c2e97c0e266e4a69f1a50eb077eec300d8a1d5b0c414c096f92b0edf516986",
        "48238eb221dcb3bc34b7538f591b6627f6e3ec64f78c706ac33fac32aac9161c",
        "48607ae53abd0f4653862f887b628a698da27ed7a6c1a81ffd02faa4eceb6dc9",
        "49090cd0f81701dd4be85f5657ec977e6f5f38c6e83b7be419c01599e469c715",
        "496e0c90322074233093e8058576b837dd6256044d6bec51f3f01187e9a54783",
        "4a3b52a63b9409d48f535245826d5d03da1cea286b5f688804d7758962056fac",
        "4aea8b80aa9f1ae2af49fb96bd2af85ebc3b70b5d501031b508fcd529f64498c",
        "4bfb244e03bb8ff80f6efb1a78cded6cfd77aefc484bcea2baaf4096ac8e1f60",
        "4c289e339029a26209e728391721664f719ba160ea9dd1b56022945ebf987367",
        "4c2c267fa1969a7ace8104730efa7a6548647057209ca35fd6699d1b4ed0eba2",
        "4c5f64a977ff1bb00f96e8b352871ed02ea9277884f5d019d6afd6a724ea3fc6",
        "4e9ad430816ef99d7c5e6f810b75a4656b10387721550916a7e39572d8d9f186",
        "4fb4317f8afba2374e6fd06840926b4706c340f7c190657fda8a83d16ffdaf57",
        "4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d",
        "5002bef2fd82834b24f57239185c536797b5e14305e4c487eb64c320d7c5f163",
        "5026bb5fad71744d9e316b6b1f4941038b976cd9a92e05c16dc3860d38bdb20f",
        "50db3554d7ecf81662e26ece4d3263afc8d2d907c2be730b488336dc0c591712",
        "51f588fd90cf907894c5c64a4134cba9e9128e761d0d453109d6351b2a529070",
        "523ea174a7465f89305b59ac494dd2d8218fdab3669cd952b68c62fabda9213f",
        "52466993addabe00fe8056092b682050d9921b57ba960e90fa15139d727fbb13",
        "52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702",
        "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa",
        "534288fd6896829ffd4d5f11629319e7196e3bf37c4fa80240ecc27e5e2e9c32",
        "5348592694839ad18c5b773a4e0e5c2eae4b9da1eae022ade0bc32219a4d4d69",
        "5350bc967e5449d9abfb528d292a661e24cffcaf1af623bb594a5ad6611a1d1e",
        "536b0ff369f1a4ff847b72d479df530d7befe53ee7e20228d3643aa25f61eab9",
        "542f1cc891ae58ce3d75f08059249725ba00eee94975796957a171c79c23e405",
        "554b09343c24d3e88467ea9fac07e00f12b301764a31b9f7998d9e4da15ed7a2",
        "55935a0a4c18aafad121b669991eae467114eb171feb9e1edbc492efcdfef2b4",
        "572a5d5f951a0e2706ade52eb30d5941010c4616bd7ccdbbf2289270748f9f0e",
        "5750f1cb959e883e2b02101d83c481d327d90eb798367a8a165e0efdb057e57c",
        "579059828c9a7c1dab3c600bdd8b41c96833f89f10a9b2885a6e0cb7911f796e",
        "59d0cdc1450332204146a033a6a0d02b8bc0b453e6decf1238cab365b193d0c2",
        "5a2a789d3e539c6419b99449d506cdb442ff86f4bc70a376a2dbf45467861f83",
        "5a37314ce34b9367b8c76a8d4c078dd61b8c2f8849f1a4af11816eb5d5ca460b",
        "5a4b32c69972352c2ba82bf69c43cbf01f3cd8896d364a14d030b805ec168a53",
        "5a6bdcb75ad1f31024f021a962221fed60cec42eae83569a48e7258a5a70ca3b",
        "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0",
        "5ac3409b403b0bcb66bf0dca152705ae0e3293c0b0718b2bce0b545907aa413a",
        "5c0df710e5013dc8b30033320bb0a7f1f76e2dd8abeaaca3adbcce086347bc81",
        "5c5abf3bb03559846315f3d0b3bc2e8500d3fee8244289bc9f467debb5d5d8bf",
        "5e1ecd488a751b906a60c3a8a118848440c2b9de21f254acc7a7bad0d8cea70f",
        "5e24f8949f8e4b6562fd124caa96710d163f724b154f1f8f57f442981d1c7dda",
        "5e2dad0854b57090a4da17fcbd36295ed1a35beac79b770b157ac2a76581a679",
        "5f3e515ff523c19d423925b42e241f64579e881f14c53c51e268b34563da09f8",
        "5fb7bda77644914e3b6b1620bd20a281ad59201dc44097d709646fde336a8de9",
        "603008e66b29bf7a4214708fb12b0d431cb16bbd9e2e854700b46939bd845c2e",
        "61845a374e09e67fb82e00aacdea4f36948de9d6f9a07f6f996b5efc74f4fdd2",
        "629dc6dcf1a5f22aadcafa822580bfb4e940a741db8d81960933b27f6c41023b",
        "645b96b843320ad382a6e708b60077f2695872f4993f7885d7528a131faf3a1b",
        "64f7951f65246510093043cdc0651a0ad1f20b2abc8a97dcb1a7475f46982f83",
        "654d8099d981cf5a52263735704976f4bb705df78d9eefec63759358d5ebb5d6",
        "6879a2e5a31cfbe41662378bd0e807b54603e40ba10bfbeb55484d803ae67da2",
        "6951f33acf47752374e291de11a6a208edde4204329d541c9aefef9435f03ca8",
        "69e018ff789453a4e0977898aa3d504f77f49a0a1c48bf29c052f60fe9f93e05",
        "69fe24ea0b3100d1a39bb40fefef2f9c6b7b426cc20b0fff51349465c9403297",
        "6a58beb7827ab98bd155cb50e7f1b9ed4e48812a9a4c9a489a4a8a2cd44e5665",
        "6a5e22a8d7370ea1caec10dacb83edfd93015cbd6af85aa74a098ce35a0cd788",
        "6afed5fbfe9583601178357387886cfb0254ba3e7d24a18aa63ae454986e2265",
        "6b0ebf0ba2f0135f57c0c397bd816b93bc0eff099284ac4815790e8cbcab93f5",
        "6b981502801d2177fbeec258d6c08325027de12bce84d0445a610a966ec7a8bb",
        "6c21bbf577087878d377116442b233670f48bfd2d879071d9aa83878db6098b7",
        "6c759e306276d443ed3b7f7d23dc9ee95b46155fe05fb8698914df90721db172",
        "6d223513f973b16aa195427fa6eafb30df3c9469cf4f29cdf1615ff141fe6b85",
        "6d7fde141b5bde94ec42195cfdea0ff59075873e43d5969bb1e7d5fffe543347",
        "6e5ff3a5e17bf78bc2302e3f5b9d296c357ef3a5760035e625deb6e953d1e58b",
        "6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c",
        "6fc618780b44cdca4b29e5e2df831e67dfee9bade4a4996c59b815c2bfdb566c",
        "716d3db7fa97840f49f7923ea7f131d11123d08c2d855872e56cd950dd915543",
        "732ad4e84e068c4bef12f663fd64d1965b610c5b8bc113d7a6d4ba67a9bed51c",
        "739e2738aedf0b4c16eea679235178e405982cebc78d47a6e8af0fedc4ddf415",
        "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da",
        "73bd771e4b08ee7b262b64d6451fa8d6ed42079f7a29ffde1f67241e6fe18696",
        "7490f7b35bb875069952c98c070eda53f8551fd876023181092cd0ab0a2bff4d",
        "74fd868eae17f718e293d3c2e6d46f36d62cd66ee7c75dd8a46538dd8d322e4f",
        "7504134220627f7b5b39f4b02b29fc6fad09c4b55ad1a0a2434f4a549d97e41d",
        "7602ddaf00417bd880adc8b1fa27c0726ede6d6d0f677a3124ca9579019d2532",
        "76d1982a71652ec3ab786ac5c6a4a1912dca757ad3e6dc24800f8cb675a26693",
        "784441af315b251e51d3439557822ed6304f38ada7b21e4b58263de41164d26b",
        "78c86987599189754116c1775160ff935fde871762d940c79878c7a661b77def",
        "79609bea4228502c1a0175336524dec906b7c9f8d4fbdd9b763fcdaaf93baa00",
        "79d186cc9f8e784ab0a3227db67014fabcf6e70d1af916b8003b7ab3ee9798a9",
        "79d43953bd857c0055b12f392a903a21f3e338211c40f20155cd057186223273",
        "7a904a54f27542d2deb09a248f50baccaec4cbb75f12e7726f32a5cb11fd3a64",
        "7a9fcb44843f40cba68db2029ca319f3cf1d77e0a5accf9946d6f609af46a8c5",
        "7aea53c0d7a37e67b5b48bc0173358fa13cce6248e39e0f781aa1f29758b4c03",
        "7b02c9f7b3e53f47041c393ec511c346b2b2db8575b2c58600ff9c6abbc2f711",
        "7b57614be5d1abd5826bb4b7096a1d2f91fdc92e36f49112bf162ea0ced57045",
        "7bb2a58f1a2613692218c36c4b52e004c6b230ce814c88d01ee7692bc36b3431",
        "7bc1cf29c53d49e72b6f60ec1d00aa3c1e9eaa2ad309ec517f895527d834f716",
        "7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf",
        "7cb41fdb7d3e58ff7ad46fe25b45c6edfd892dc6637c520e6d406830d9ee656e",
        "7e5a5303ed3dadeff746882768259191cee4ea07fa2f085d4ce4248ca323f275",
        "7e73103183333912e507005c407916077bf28624b6ac5b496d133471ec0f153e",
        "7e7349c9400276b8fb899a1529b3f73d7cb8dcd06e5bf9f9122352195e4ab009",
        "7ea4cb26971c20c55fa864dc747d47304218d8acf220c036dfe248ae70413c6d",
        "7f4dc90a5c94460b71ae76c8ac68e7d05f0ebb467d01fb7ea51d99543756a4e7",
        "801912a55ec9676a18148c0d157b13defda3a4fa32eb2031cb33a06bf34eced3",
        "809f7022dfa3fccadb7dde43425214bad0c29ccfad2f385c8e8160cd78a223d9",
        "82634893d43bfd409d3bd74ff9ec91798351f3838f1c3316306bac184ad9fbbd",
        "82a3f771bb1e0b7355233583ac7b8bbaaef5a6071850b192928a6def943ef99f",
        "82f8b359abe06e9e819a39bdc817671a33f71ad4da8e0cbe153e256a51cf6614",
        "832e2a54e97769b75244fe66cfe0831a9c3b42f7dac51cca979664348310f20d",
        "833529a6d19d4bc77fa3258a14c55d1c5df9826475071bcad247af5b7a2873d4",
        "84a1b895ed403cf2563a10168d677dbd30a33f5f673cc16269123f2f60eef26c",
        "84c781b5d7e3445d472ea78f86da8ce1f7cf3f8a699eed9e76e2fde2284fa9b6",
        "84d519c22a52aacb097a3e1b39c2fd22f588ad961b1872368582e084f07a9a5b",
        "84ea87bfc14c2431da33275879fd9e8ff5b2682d471b37efbe776f64b18f3b74",
        "85069175ede2f68935a076d4a7ebac740d3d67ea4502b6ef5864c9c96cd3aaf5",
        "86625614215c3d0a63e31d89b2b9700f88789742bf89c1b88867f190ee5bf4c7",
        "872eac49c7dd64742ee4df62a4fd0db3f46e56abe0a9bd4cd14011f5f664bc2c",
        "88104cfa7a900d2bec2923e601971c3e0b7503a088e0c18f613b17aed2f67bf2",
        "8845ff0342546f8d7b940bed4542d73e45c9eafc304446062ff74b540f14cb33",
        "8a101bf1e00f58aad23d45a3480ec9be8f61c53291a539e850ec8e28451a7867",
        "8aa074d7774276eb3643005f5dfdd1dd36e3eb185ff4f813c8c65123b48efe26",
        "8b6854d53db1c4ddb4b0552df722e867ea67da45644eaae806b19980c4364cae",
        "8b88fe5cd436a9a4d3e82af9529cfe2656ea0ed422a8a277c28394f0be169af5",
        "8b894782c6b6f3c17dd017f5d28c5432598d4623bbc3b6dbb72914200b53ed38",
        "8be5073be28edfa0590359329a854d0ba7f8efcc0c6583c505d2eeb927daba3d",
        "8c6d95b88481d2a67c88ffad1dab8509749c93c2efe69321267bce696d130a00",
        "8c903a42058f8c061e0ac04774423f38db410d1e722fc064f396819812a326b7",
        "8ca97d45c7f138264453c59850c61418a17157ff753e8429cf768b1d2346a2e6",
        "8ccc69034e84be4e3eb261bebc76e8ec213bfd7df8ee1337f29ae0414882edab",
        "8d6d6cb862835d0e88e9ffff213d660844b354d9bbc40a1c20e25ca9fab1ce54",
        "8e07d59765e791db3560b68e26872f656315dd252503d74138cdf807c73f03e9",
        "8f0842febd6cec024641c461cbc330b135a5a5fbe195f065bfc4dace540ab252",
        "8f17a455f083ca225033b6762e54d0f014075b3d61d4e2d0a735621cbdffad36",
        "8f3a2a28b969b1efa3ea8182340fd6139c0fc6eb8b000260f4ad808376ec81be",
        "910186f71d6fb2ab39f4892312fd68cfd41181e831ad48c3e7d4a00fd3b1d85e",
        "9103d0c4bc475d88e46d9e60dcc76d6afec18e164dfaeed964be0d74521748c3",
        "913f6be4ae1d3db6d34a117bd8cfeab1ee80553234a0a3f4d045b86d1f74dcc7",
        "91ac11f4f00a65b8efdaf9acd840fb61dee7a83cdbd51b27a0939b4188201497",
        "91db24b1a60dbc40fb58309078d3542b737cc44af8919be2e93e8908b2703b05",
        "925a7dbade5a9add68d7bd18877eeec844a152a5415551895f463241d7526ba6",
        "933605d60b43156aae311dc0326c1a26513f24d60360475493a1a3e5899cbf5a",
        "939dc5906fbe36b2d3bec9a5147e90bb69a42e23c325a3cc9d41b68e01a36c23",
        "93a3837297f6c86a1665fc0a4e667e54dc2290c33c706c5202a4cee82cfe7e34",
        "93d6fb255dc80d575b9b515a51250881c995c8b305331be403bf3ae65a73b5b0",
        "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f",
        "94d3fea4ad1a98d1fcf7bc9fb35895295a014d22f586dae3c0bd772dbbc3ea0f",
        "9519ff8b41810dafe604cd9ce90e3c13bfbf334caa2f0dcba6c65bad5b7d3917",
        "957e01a664078a8732f39781ad1fb2b7bc8a0aecdfa8dfc5cb787aaafdd9c1e0",
        "95cbc60ecc63c7635ac55c725ec84b44e4f9c00a68c342d65d58288fc1b80806",
        "96428333dc4c66d8ec4cd25a068960fc7c811d5f6ffdf7edf44011de79003e08",
        "97087bafc56a2d4f93d4c6accbd2382da6c38c692c198c51ff9d33464c9d7880",
        "97237d2051cb25482bb69bc6560cfb3101132a213b2a8366da34d4623f35a829",
        "97d77747c028998223889e830f9e84552efe0ef5544d826659fe057d75f4d088",
        "98468f9a301a325c4948a857aed119f7bdc5b131c90d582fe9ceceda00a7feec",
        "9883c5bcb7fc6768e12c1837257877debec4da66a9cc1fdbb3b81141adbf3d29",
        "995e053993aa15d9295c6e469f2949a47eef9b82ec324ba4ea9d6420e0f3c951",
        "99674d4d910d309bba84ebb02b7d41470bf6201d53e98e88d042e014d3ded7a4",
        "99f4ca8bd6398a74aa717986dab75602733fb38cd2b7697c678f5e6db59c5528",
        "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2",
        "9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d",
        "9bc835bcbbdfd429efaa21d664c98c3a37971172e62520521a847e6f704486a6",
        "9c034ae78be7ff3e4f9bd0e3e3e75b7e1c8d9bf80aef0d955d293f017963f3bb",
        "9c48f8e91dc736d7992a0e8cdd518e5975505a3c2eb267935cfc698cd209cf64",
        "9c8b2182f9731781d7717f2d3f3f23c6a91d771f47977d1cf89cec91274f725a",
        "9e87466fc830a872ccea32b26330d0cd0da8c411098d858bc3fc3e0fbaf5f06b",
        "9ec23e770f33b7b955067ea357e90aa6ebfe911a06553e879607171acaffa649",
        "9f193c144559a55d2a6a0189d456db752b7848790c16e103ad096e86c58633d7",
        "9f656e5df280f94cdedf147e3429fddf854bc7bdab0aaa1cc17d4701303177b3",
        "9f8d60868d440583cdd61587ccdd3cda02e7d1f253de72b815fe53661ec7f8f6",
        "a01ee158cf53221f587142bbe18be8182bc7413a73f07f2c778d384032e90b16",
        "a07e62008334141b3baf20ea764dea9a743a7bd6d8105d96ce9f8245c0f4e51e",
        "a2a45d40b57584eaa03e4441fe951616b9e4e823ab3529df744e075d1b412df5",
        "a320fd6bb0056bd0cf6deeee585b3d91b549da20394122bf750f62b980fac7d8",
        "a340a412f742c428a4d3c1a620cff46b498193b1f6ad047cb66d20e983a0dc49",
        "a43c109760d005ce45aa7772904ad221a26944246a8771141957dfa1200043a7",
        "a5a025e69369fcc09066ee6a55e6a21da857c6f6da0868443cc843bec7cb4fb3",
        "a61bfa682062d6c25f32724afd3e445e3c73d70ac2cea6d55e3b3488a5d039f9",
        "a6f2c036d5c9372f27f8a8a283fb280980a4d61af025e91dc28151e5b2e53aff",
        "a715baa2655a1ecb97c9837ff1aebc76d7cc937d9f734d8e9e2e2e5642e57c94",
        "a76ef1031e08ce99aabd2fd2cb4d95f4e536f6265fea201bc96bec1397ca38a8",
        "a7dbfdada1b8ddc08ff13bf435093130ed8445a26231f90649346d1300b28b62",
        "a8dba48eaec1441c854bff68e3da77ee0a3f66120f990af7148f5d01eb0f9495",
        "a9b25f7902ac22fb9a5411d7b48addefc820d1058045c0214057310032727b66",
        "aaa19f33543d863bb6c5db7aa13be40cecf67cf603c5b938dca75b5c5749cfe6",
        "aabc29834675092460928cad3d14c02ed52fea12ea5e5cca04a53337adb70995",
        "aaf5b8f11b6af1965ce06fd8772a38ec3be7929ddcb3d510aa609c73837d60e2",
        "ac9b68122ce36ce428fd61ff1e2668ad277344b517b3c13568e59750941c07e8",
        "ac9dd9843ce6c740975fb1dcc234d60c7e6802956d46c45ef89dacc9eab0782b",
        "acb00dc8904d0a52a07fc803543bbdf0e5be3922b0a2923d042ae4ffe085ef69",
        "ad0dec9cc6060ed845c2c9f34c7ad29c84f3a1e55e17a6a09b825e91ccbe1f69",
        "adb2a3a0577590a4afd3cfd5b53355d19eccfac63a276c9eb051f22197b3ee74",
        "ae3467e7594c291ef22ec3f2c8adf7e0b5a12b388da57cc37ba14f46dac2a39d",
        "ae4cac14f345565b8bf464803daa7547ecf89324ee58fc2c8881a650a0e9ce35",
        "ae61dd9a09fb101c892797205acb62265c875aa30b90b56b1a4db74ad5db51a1",
        "ae6aad45301e12d1d98373121950dfc948cccb6eb92451396ea67ea3c46a27b0",
        "aeca10e59581f2db12a02f91b9cda1ff4468bd49bb1f6c0faa194addbe89c21e",
        "af0096c04727801517155ad3921bb7bcd3e5e3eea43a6db8730161dfb7d86150",
        "afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8",
        "afcfd2b955224c1a1d206f42150b5621b3ac19d179640f850f7b2b6eca6cf529",
        "aff44d9f03d145272cb59e063b396ac9a551dcde6719d47a519325add9919133",
        "b023f824cc3449f765a96befb91ec09cfdea998ef440fbd28338ccd17594ab43",
        "b08c06cea580c2d0581b1a00bd624d39d8d5826424b0386c70c56a879718920c",
        "b0a9eb7ee72d5f14710031b765aa3e3770f2c4898038e5f3b7c36bd7f34837cd",
        "b190bc7f753e3c6a97e817632ce4c27f92790274966d7355ea48c89123ef4ce7",
        "b1cdc1c0cb639d926017c2799b3b276eb1bed75f629fa34fd29b6090a308a5f5",
        "b27c9166968842b44d2a71f45d12c95b849f1f75f055f1432f5033b725870482",
        "b425474a29d5f87a96baea6a9ea96e8d0102d4cc31b7c64e1eb66cf0ce76ebe0",
        "b43df56cf7144bb4ff5cee69b6f9ed36aeaf264e6da31a9648b47836d7d6c61b",
        "b470cab33b62d61905e0be960907f6c7222241091bafe830271d233bde5959a2",
        "b4bd5c3fa6fb8c882119a4851113429f8d8f6ad7102adb661d1f969533d78650",
        "b5a9eb33c61cd2e7f6b9c1811b33a9afc5139104032e5fc1c3ee304aab1857bd",
        "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9",
        "b759ab03ab4ded0f6935f4c13687c152ef6501a411899d0899540c590f01f06e",
        "b7933056ddb1814343fb0171452de15440b5cc099e5a51fba9728cb1c2da3131",
        "b8ccb7972c65976f175e51030f9f0f8a2e235ca0c106daed7a83e1549db89fde",
        "ba645d6e149038c455bef602868be3cf5793b734efd4ec47ea7c9a85c8faf6ce",
        "bac13e02a8a0a8840618c1b3096cae97f040a39617f8ebb986190c1ae3a22872",
        "bb177c55d68e02b4d556ba586a76c0ffbf4404d9427ca2b2137eaae5068b5e4c",
        "bc2272b35b5fdb24335fafaf13e0e1f5dd02df7c94eca6a4d46c09eed6b72322",
        "bc5706333943123da156f700aa442af388ac9e5d5109cd50ea05bf95ec5a68d2",
        "bda3daf533e9310d9965523e6e60a046b570647f949407c5673c8991b2529160",
        "bdf2a586a57ee532d3e16bddb113abb1d9bfb7bdde8b82d5ba41e207fdc66287",
        "be044cb2921963fcbd5a7f3126f82e2e5103e1a5413a43557ad8357988af36da",
        "be7edd08d9287c9147ad600f44988ad2dec9392ace303303b6cb7468dc5aff8a",
        "bf381d76f0ec94b83d96c58f5cf210043294e3f24b0ea150ff395ad1f179ffb9",
        "bfb1074c9af111a83e2cd6a7b12946f4ba203fae38d9fe2ff50beaa13946814f",
        "bfc9c281981546238982e86941c53e487132fc5bd21387154ce3ce94bd1d09cd",
        "c0c898ba9a173a288711e81897664695802738429a412046eea4ae6e638b074d",
        "c0cc80e9013aae3515c93cc07d3f8ea7593e5f8fb785020bb21f9b21a99672ed",
        "c0f31ebf90e95e558d8248b0417e38d894a21aa6c9a420d76882de0aec2d2d7d",
        "c1c1214f22057ca1dc301122153c384cc156e48c65c7c3ff131f4d78e4c95f1a",
        "c260477ecdcd19c60ea03c5abc46fdf52d0d6a18b3b82ac61c0a1b9b861bb639",
        "c2779e2946635ba95b7cef8c17b5dde15d2a1ef658c16d8f54900b2aa48b9aab",
        "c449937a8845230ac0083e6afda802eaa5a15cb42924dc1302476f4b6610a3c4",
        "c56e579bf2a6a7cc5dbba873af05cac6825c6a6444970ccae8f47ffb89c9a779",
        "c5d381233bd27cba97be3b4153ced57368e7db5e0aed725169916082dd64d908",
        "c64aaa3c557c3f7453e14f41776222e3ac3c0d60f2362fc0f0fbf5852e23ccd7",
        "c6b05108697229cffa4c3c4234c0eb8a75b86267fcaa8a540f077630d96fd010",
        "c7935a7f4473e143b75bdc3ff9ba5a1d3d8e59ce5718f506ef1cd9d8eac451f0",
        "c83c7c59e0d48664530035a1d7c26dcc17e058f45d33e9ba3dd4d07b6f868c3c",
        "c8ac8f2eb12ce4f91f4563fecea608dd07aa274e78de369fa8c8b7ff00ba75d1",
        "c8d778ea4fe0d8e55346e20e1baa5fb29d2659d7c426b3c425924bad7bd4a8e5",
        "c90b5c25e09f60c2f1db99faf48d7c9009d1371c48fa0f5fd6ab7c9c46fd0e0c",
        "c93975ecca0d596837882f06dca4a91913c0f01597cda93ce7024da04fc116e8",
        "c97f45b471eec4bf6ab3e17eea0ecf2be2dc5356bfce9641d0b7a356317beb75",
        "c9e63ea8f1b5c715c85653c47295e7a0d184a67fbd2742db675444c7f7d4f21d",
        "ca7907d36e102a9283309374bec9fd25d45bf72d9d4ad6e3f882c8520e4e3318",
        "cb24a1058af800bb3f95ff519f31a0b64d6faf1505cf6e466149796595e381d1",
        "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb",
        "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15",
        "ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598",
        "cf770743831400e9105f9101e5301b8017272c658f0c9adb342049c996f13d26",
        "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4",
        "cfe71350ee6567582415e9a4138da7eb9ba7d9d4a85de3c9bc96ab8a5c5f7d06",
        "cfecd4b315f0fa7c19d86a962e090790f98d488483768f086a4b3febc14ee63e",
        "d05a1c73e6ade740542753b28312615cd5eb3ff3d2b6b57044a5c2c118c7a421",
        "d08a942300e44dc4ef511ca80df9c347ae67870c84c77971ddecaa1cb9f09d83",
        "d142030e9e790e0c6ff0583b2d672ad7d9bf7b4fbeee82a818589b124341406c",
        "d18a9cf83a168e0fb64a5d254735362137270d0a1260161abd56a7a28c5933cb",
        "d19ac954c80404f80962102a97ae77e2976bd7cc4a243f29fde9e41b28c76a72",
        "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590",
        "d2ad4251172f55d71ee795f36ba27d11fdfb58cc8b7fb1254829d1e9923d48ac",
        "d42f0f6711c6bb570e00826197d6ca30b0061d47269ce5985dac442bc949b72e",
        "d454458a7aedc172a1d8536ca57130076a71147c110e287ff4d5c29928978abc",
        "d47772d723d1dd5360efad690343c01c4f081b361a4fdbac221377cf66d8ffb2",
        "d593c66119a047938a404e9b553cb185b31375a77243d0168d2bcbd10c308635",
        "d5cf564183cff5e62316dad4d09936d49c0cb94760274de70f704a56650c6636",
        "d5f7300e3e716c7c618c6e7669a76f000730dcd6805add117b381c9aea3ce141",
        "d71b26459af241c9e1dfd46f88409f2f7b7747d3f0263d13b23f41dc4deb0f84",
        "d74f97f50afbc08e91924ebf0227e3bfbc6b94dc8466d16ac760783b3e327ac4",
        "d7750be2725f5195f8dd5d2aa70dab9887662a1fdf9591a39e89ce34a9fa24b5",
        "d7bcbf0ff5110d3f0b9cb6be138a16c0679c2ebc78e201a9343b53de464a8378",
        "d956aa170633f552a86a58b7752dedbdc2425efb9a38d7cd62c53fb8ff20e7e7",
        "d95c6a0ca57babe046c6dda8ca201237ce8f379ff99445685d1a51444b2d0539",
        "d99bc901b1802af0bd898a6327beafccc15295abc9cd9b7a37f66461ac940a7c",
        "d9baefc1858ab5dc02a659e597c0c07862498d1e31af735b64dbac9b0a30b013",
        "da336ff5d6bbb6a30ad59a0dd798c7e6e1e57d719bbb6300725786c3648c658d",
        "db01144474a340ccda95bc6bad42af70059e02882f71419c357c2f057adfbd46",
        "db9f74144fbee18f1abcce0b2ed76d417d9146d927fd4bd5ab52a25a2e4f60e0",
        "dca03fa7db7f47f12402bf6ef16928722334ec1878193f5275cdd97b8787e997",
        "dcd7af50f2ca2246d29e2dfa00b503b713c691419b518f7aac2467199c18a471",
        "dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e",
        "ddcf16656c16511860a8548a93484954cdcf8474b4d35e4287c7bf276a4724e5",
        "de0b9e5f4aa8db9792c37c95f423b814ba552d4487c2f9e979297afd5d8347c5",
        "dfdf4a58a1b0beeb32884859a6ac323a647f63483e0161ef703cb08536a6b10c",
        "e0f3a8cb7b4dffa5f17a8c2f00da09c435a96837f78e5624503e7bdc02d4d319",
        "e1026c6bf522cc189a9c0f6e9b2e590c39bdaabe43f09650a917ae246116ee0d",
        "e21f9188f2769d54dbc900ad0fcb700bee99d22dcce30b83529c1015856be769",
        "e298e5778e25887b57f72069ba5d5f67e842176077e77869cb50c3e1c166b9ad",
        "e327b35e2b01d84b108447cf1bd62958a3a0431b96631ab4f225c0b10e274f1f",
        "e3cf0297c2110cb338bc7eabb980696fc7ab285e5520d2de1adfabb8ffbf910f",
        "e45d790374879beb73cee2a8773f2f5889769b03cb5f34e7f3e9dafc53cbbfab",
        "e47691f372a7c7239774f9a4b4bb85fdce403cd53b287e5ee4e4531e321f63e5",
        "e4a2f125a5bcec09b1eaafb442187256b4869a498e6c28c557b7b8bd954391db",
        "e4a85dcbfa97f164838f9d498940923f6fc29e72c25963728e7eaf4283c01d73",
        "e5564888e7d2311287bf7eb5779da7677651cb9ba27b2a28c4c150538135219b",
        "e5b21546e18dccaa42a7cc478bc235f66f4ddb478087f31fd84fc72e6e68548b",
        "e6334705eba3fc25c072f92d1250357efbd1282e2e2064638610c81e48f86a6f",
        "e6d4444ff0dc11a971924357057fc5dc652566f1ddacd43c89cd5f52dac6316f",
        "e74e439a0e4120562bce4a3f58259e0dcf2088a8442213bca7b0eda2832ad2eb",
        "e88e0ff56c146abe76afdf992728de128bed02949793736ec3facb590d2b7266",
        "e8a6c8122cfb659eaf00772181778ceee04caed44a53b7a21e8a6bc571fc440c",
        "e9bad28bf85fc33bdba52632c660d759c1f11e03e8f60d5d8a0071f48047e6d9",
        "ea1098c501075aab7d71ee024e0fd295556d07813c0346a09168fdcaab86cea5",
        "ea529b3ddc83c5b374014cdeabe063f8386e49aad212abe735c459ca3fcd05d7",
        "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658",
        "eb980c0d1f697ae5be4dc3f8e0cd8cb1a132eaf615764daef2089643bb060ed2",
        "ec3c6879266f266306a6f5ddb343b63e0254df0dcc8953ee81a4f3a24f336f0b",
        "ec403d97694d420ba720313dae07fbd3a16b866cbcfccfec4efc1c585902aefa",
        "ecbfa76831776eee403f0fdc544146d8549f04be032809c28d584795ddbb9aa1",
        "ecf6e3ba6580fb02df7b93f1cd4df1b9ff2a887f371a7fc80871dc0b111de61e",
        "eec03608aa86a67e850572e4db995161501b5566a1c7aa1f6ea2063a67cf65cb",
        "eec0defdc8aa9ab4b527685f82d13d856908dcdd20546b9b789db640490536bc",
        "ef0c2313784560e2e656056a467313f939e073f6512bad4a3d6c108469b876a6",
        "f01b1c57e87593a09704a1b1b5ed11a25ad29c7ee6aee265402350d0991a6b70",
        "f05ff34f430256dc7253b56f1024f081ee28349634fa2209c784da792d590c26",
        "f0bee1cd67309fe31081d761441b57dcae03878c8dd9c313afd849471f0d2b18",
        "f2f49b468edc6b1259a03d37c9635c3525e11ce7388ab69d63d77cf3755741f2",
        "f310ab76bb2163aae9f973921b6790416f45ad22ea35a2b5e7ec67229e45918a",
        "f31dd96a7c33c1a8c637f74bf6543d82fd8e4704b36a8c8f86367d25759a47f3",
        "f34e9c3bf8efcda015b9b0585d6020468a61e7bc934ae12f2f8dc0cd899b0bf1",
        "f3c4d5d0ddda563a87618dc4ecf699325d234db5bd180b74f22de9645d9ce3c6",
        "f44bf18f230c4a1d43c3831b40eeb132a4967700cce72e8de3ce0292cb903b9e",
        "f530fa7a52c6b8ef83414abe8b1c74ad0682d063f54664f0dc68881d20c71f5a",
        "f608e2fb0b0bd033c3443839546fbd8ae4db171ffd1e6ac4ffe222af20ed8cdc",
        "f6b3e144a19d3c1f9c31bd98f473e1b965c19eb9b2a339a20debd21779f9d4b7",
        "f6f27fa956d89340c7de3b3c63a2b4879464086e56db720db139bff73e9c2428",
        "f74621187c05319b39173fa8bc2b0f9c9e1c036c8579e12d999ef957aeb59619",
        "f8c03a9735ba64b462c39bc2bc086e0774058efa3024922eddffd08804bc1c97",
        "f92564e785ca8906d32f8cb9ad9510686d3f278fbc83f5d9241d56debe4249fb",
        "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af",
        "f9c7379080ec3c41ce5d4a5aba40cb80e8ced1a67f554ac5bd1e368ffa7473de",
        "f9f3c9ff60e3c3c6c85bf4d92bca7f59e26f7cd8ab8885f11a441cbd37785340",
        "fa7532744eac8984be7b273303911a2ff33c60127fb3d6d57e609ac2b086241c",
        "fa78442f866d05d324ed32ac2e1504e2bb89af4347ad1ccd4c76d093a2e3b541",
        "fa8c979d8be2fa47e99076d4be7b3b3357bd5fb3fb13bce77c3ec65dc9743b4f",
        "fad8963f9e226325c2939992e1b929098a13caf7cf5c74a45e44cd45eb2288b9",
        "fb361ede3e32d51a622ae3798d313a44a7999cf4f77c36eb6bceba6756be97f5",
        "fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada",
        "fd75cae68ebede83272b178b11d57427c0282b5389f99338f1381825e113010c",
        "fe6b4dca4cd1ba8e048648da3ad1b4a6aaec1d217f24fc25b943fb0566036042",
        "ff1592f5c2bfa041315589e205aede977b6b9ca86acdd801118ba115d010ace1",
        "ff16a5a512ef6c17806594cb234e11e946b694dc80191a474908b50b05d0f3d5",
        "ff1c77b30e1a75e2ce7150abcf0a26da6fc35eac564aeb0261a145623a8af92c",
    ),
    "BSL-1.0": (
        "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded",
    ),
    "CC-BY-SA-4.0": (
        "78c8336927ad14d0331cd217a64fe959d711630ee01f03ae87990808d7681e79",
    ),
    "CC0-1.0": (
        "42e5c3e2dc951231f2f015709c4dce5e7c7b5cec0527b379b23e49bfafea1472",
    ),
    "GFDL-1.2": (
        "9399ccd92b82552c7bb29b7dbc9056b0b770d0297e6f67595af557db51cc42ba",
    ),
    "GFDL-1.3": (
        "bcecbb447ca30100a4d205f8e22ea2baa24c40610a6fa5e463f8d851d9bc8305",
    ),
    "GPL-1.0": (
        "4987724e8cc3b7e940445c20e84fc9c73a235db1d092b2332f45fddd50ed782e",
        "5337e0fb41ac565b74d17b266a2c91c0a9b6ed4b17c3c0cbccd4f1ba7f01491b",
        "d5530ac092131d457b8321b3abd1e6d5c568403a469caad2f43c0f62f39ba54a",
    ),
    "GPL-2.0": (
        "23951fdca94374490f564a5f4e0906d84d0eeddb4c4a36d46f1ba9e74d59382f",
        "300994eaf3ba0c446daf879379a693ce4d86e19f09cef6c9b6a20a78e6e3068f",
        "4cc7718333d0f8ef4da84fbb3610ecdde02080d0613c324ed3c4e7c797f38c99",
        "4cf61665f6ab1a6f8439aaebfd5293c886819cb5002cb4e0382f36caa6d51194",
        "651534f1045d73afb62d57a47cbf972293712c53b325f8216afc9bfaa0578c2b",
        "6f5f7435acd58d1014c4e169380580a9126a6e84b0b5fba95df33ba2def24c5a",
        "7b3a67ba65c35b4e520f8530ecf11c6f01e9bccb72367eef6057240b6b6f804c",
        "9ed6f8a8efd93f49b3134d333b9d367a12b51503edaefcfffc7bc9629a55706a",
        "cb574d8bd9052bf38be988d2073816406e11014375983a486b2f021c4a39006b",
        "d26b423f20fed33ddfb0a69ca324475cca620571d7345a1b16f293b6c24c44e1",
        "d652b058f50a310288b0f69743f3a5356f8a12da4d2f279279a9dea38a81a605",
        "f720a467cb59ad5a4cdc41e8b34c91f4b8840c912ccdc625dec5953b950b82bb",
    ),
    "GPL-3.0": (
        "6e425f409282069849afefa619bedb21d2210389ce56acb1575378a7cc8853a3",
        "83e0ca3224b0b6e8afd4c358644de4ec920cfd427f8c879cbb1add4087f0c3ce",
        "842fccbaaaa15a4e6a2b744f7be5205435cc2d3cb8d13e79f46edbe79a3369e2",
        "a1bee3133999a1eaa0e0eaea031f13c75f183d656839b61c551c7bae5433ebb2",
        "e4d83e29f3ed8ec15776959c8a69dbc74f02354517aebc568407d2d3f29c28c1",
        "ec0a7ef54613eec416b496b617da417d942fbdc2d0363f56111a42de5bee30e9",
    ),
    "ISC": (
        "14b33e9fbb471eb2135ca8fe181d60b4eb80b72b4563d37b92084821f9a8dbc3",
        "17eff8e0d374664f6a8a61ba8305ce6edf27b630facd7ed88eda14b4de5f2bc6",
        "1ed7296301d616a11b9a1e23a9f15ed4195117107d1aa7e1b411c2682d11fb98",
        "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a",
        "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1",
        "27a8f65cd5d6f2182bd01502dc7ea70262f56f38a976116efc0c9901276c3bb4",
        "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29",
        "330702b03c47405c3ad2bb4d409ded362a9535f4aa7a8bff9507decef88bfb49",
        "3dc12d73102aba64473db007f9d57547ad2bf6ec87d530ae8b8d93b316648003",
        "405c996ee6b3d941da5bf20bf530a32d01e779b0a1b5cd4525a167812fd4f366",
        "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db",
        "435ca650afbfede5210efad0a221cc6642e7449a0f4fda7e64293098bc71f793",
        "5456fff23cf44064ff54d9d973cf8a7204e2788759d3d01ba3de38afc4515eee",
        "59b499ac3569651a9a545732768629145f9c851359bb442638a5859f19cbe457",
        "673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317",
        "691cba45299d17f1ec9960ef3a1c34ead34e6c0f0bde4a5358c581c8742daa6f",
        "6ae81ac2e70ef9097a9ff33d0a6d712b66ac6e67bdcd1a95cf1ae7e17304ae84",
        "71e638daa9a9b5572892642ad3b2898d7860124998d2bff139e1f88d7dd38679",
        "77e9889024ef4c09ad3e65c9c303459fdde03c84e2f9d24ba9d7cebb938ff23a",
        "7f69d6cc51865da22f16bcad4908b990321cfc04f729e474931b5ac43059d745",
        "80c91bc2efd3e78116e00fde9052e737ea04907e8766e36081f7f7c856edfa95",
        "8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc",
        "83381f2ba91f8b4b5a524e928f0229510a7656a35772582d1c5e0f3ac5112220",
        "86cadf6b8ff9a33f9f1268672376624474ebcae80a1a08747115581a22146101",
        "8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f",
        "929ea44171ff3ef7e5d1c64ee12f9422c4d18c944cd72a089a8c58e61f5f984d",
        "99ce883ead9e47ca35ee72f9649fad19dcae3ba264a7bf41e6bfe6ad6f020bd6",
        "9a726b05ee0981acd5fac49c08feff147536e6e51e9316c606d6f0fb828c45c3",
        "9cc6f7d1685f457b0a8a5d34813895aae1b707c262f291323834bab4056d27b1",
        "a285b2987fbd98096b971c73f42998e424fd3014a9690457259734f639dee8eb",
        "a6384b33afd7f77584664a3a36644717281a88522df1f957bee8eef971453563",
        "bb7a7962f5774a5aa102d77fce97308caa6bead07a624c64b3c0e7e48f6a4bad",
        "be2c29958d15f6c9e0cca655dea648f2af2f5eea658fbade8cf87b8234a39887",
        "c191f9994d185d4eb495ab7f6baf68adca6bb5aa6776c292daaa3fe83e0f537b",
        "da58e8edc71ef8907bfaab314bf5ab25ca8d92ce8ba2622a25e3def5ed249fc4",
        "e5f494ef6a8765684eb68997254b0a16110aea1da8a97552074ac41fb8f29bee",
        "ecc35812e0b550c0c4345eaf78cfdef878226a5e582237455957bb6624d84fc4",
        "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee",
        "f9324348da82c2d9b4a0b0b8229973a6806c67a5b5628e587181e15e03c66d69",
        "fd4e450e334b5e7722a9cb4a5ef92dda5eeb172eeee17b631a720d12591461b1",
    ),
    "LGPL-2.0": (
        "0ce8693be2f1a38a811d75eb0b71a2161f6b22597ea4ef19dd19f903e9b00553",
        "8516ce142c8a6c4984aea0c29f68bb3b7c3e0ab4a1e0df66e9650cd5004d7ca1",
        "aef436a7f4191ac8b59ae18aa53a4bd9d10915f143ce22b420ef6d7a07d029ad",
    ),
    "LGPL-2.1": (
        "35f8d69ca48abdab7074e36e1b0f9eeaef0e52023552b7de90b54e6800676efb",
        "4c0e31071a3387f7e9a25974f05a970bc237220ca37b4f43dc9a1103959048aa",
        "5975fd84ab96a11128a387d902750253a64d2bfa359f0b5f68124f4082ffa431",
        "73f8771023a7bd97f99604cee25be5ea96b506e8a15023953726f00bcf5e8cf9",
        "af577dff7052982dfe3f9fd1a0e3387b34e338043033265bfe6fdaa4a5245d30",
        "ea0b3d6787fb89b5d47c82d3ec6124066e2d51b386175d11292924c07224b34c",
    ),
    "LGPL-3.0": (
        "91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986",
    ),
    "MIT": (
        "00a5c934b705d69594539c6a37a1105192217249a30fe111a375560a492639c9",
        "09b08e50430d6a9f184d1fdcdb06f67e549b585c3321f54a9d9731870f0a8b9a",
        "0cd83cdf70e0e0baa68d09398c9f91dcebf1488ba72487c224caaed7dc250c1a",
        "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c",
        "0eae7dc8245e34d9bd58b3c08e725a0cec7066d9b7cb0026aa2aac6dc0e0cf1d",
        "10e76eb229db0241dfe4cacdd36d0383a1a56d11194e24dc3e2bec5b0363441d",
        "13f6d2a43378efbe1478899a14df957aa5a27507089fd77c372f4bec3d2cd54f",
        "1bd6e274d19e3584599b9e5c6db7071a9aabe02b74065120232980675bdbcd47",
        "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164",
        "3d0015c80d318bbd90894de0f6e75d538a79c1f19dff4bc4c616f020aec54050",
        "4e82a4640cdb79773f225ed2420119689869332eb92de6ed0a8f78bda42a4acb",
        "521198d92e400608efc6aa9b2344d12d11ea92e76e94d6c6c4815f701351a8ff",
        "63184c25df999c3bf2dcfa0d7c4e30ee6e9120c15b23beadabbbdb0e9e1c6477",
        "6733127d88b7d3bd59c42da120690dbdff1e658acf3fa3e2448092079ad6999a",
        "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f",
        "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127",
        "784635de5cd99402f48023bab2f7d14e0ae18e5fe36be22e09f273bfb567d09b",
        "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4",
        "8299a982df02c00dd2479ced5674969eb8a55addfcc252fcc582a269ed31444c",
        "8cde46b543036122641d289a848d3900df55f9efa471b2ff7354da3a6e4a113d",
        "95d6e15f26b09973979cc939f067e143dab922c3ae8273ea44b568d429da0660",
        "9803b59d0b48bc4c33519eaf3d6e133d08c752f8f17a5cd3d6198abdf08e49c4",
        "a64b19d92f0c70b4141a889167700172dd7c66bc104f5443368f51e68cd95b4c",
        "c9e0b21ff70f6dd1855f8a502dd7a9f1911ad6fcf2dfadda0b0770fd5a43808c",
        "cb4b61896f7602532874db41e6826610dfbc09f9a595bb63721f7c01e2d8e3e2",
        "e04155628c3a948ed356992fbcb283df99fce5b70ef453f9433a4c43ecb74303",
        "e1abf02d50cbb5071709bb9d15a7cdabfb7dee5f90317a82cd7745702c97e91b",
        "e6efdc968de004456b25b55c6664804c4cf6c1a284deb105868631cebb22f3d2",
        "f75fdc2da8f9dfb1af7a3fcc81b15ccb32867bbafb1e1025d0656328db38fc4e",
        "f9949153c4b48f559fb56ab7015fc0c24d9414a1e875cd6c12fb989d05cab7b0",
        "fb691d28b64b2a306b30449f04b63780c13263eccc568cc65d7f25fe9748dba2",
        "fe8f021ed0d2237a7ab8b167ff412a7aaea18c79b849c12ce65af3b861efe732",
    ),
    "MPL-1.1": (
        "f8ac7b08e90fccee90a3e88cae0e977c8b0880eef9e2d8c77eb0d2df9e7c5679",
    ),
    "MPL-2.0": (
        "a8e65d84dc49905541b3c0308843a26aec2d19c0792b46ac3443015259bccdcd",
    ),
    "Unicode-3.0": (
        "5c0ca91f05bae6fa02e82c56afc5e30fbe8d6f5117a5e15adc2a9e0a5b5d9e67",
    ),
    "Unlicense": (
        "41f84c538b3bc6dcfe6afaab48f6e16c34fd1b11b2c6be7db47873ba3bce291a",
        "6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf",
        "6343a29688390289d15287cc36e2826dba393cc9979176acd38ce2df41614be1",
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
        "7b561546e6595918236ec2a55f50b6f3481149d09feeea46f14e76df6383dc59",
        "9137ac0fab84d2bbd40d528074283e83bc514a40cae572819c6a647f087f1480",
        "949ed4ea1ab6bf8cf4e1be5bdb90ec5f0a0bcd885bc68f88d6b1c28ce202e92f",
        "98f0ce274471690740f65dc7288f4c6aafef30303e633390c278a74d426c586e",
        "b527b4e965100746a31d6f14a64d6d3dbcc3282d27f78dbd60f6af9eda20b602",
        "d16b8030b26277b62374daad8fb9ea5270cce631a73755d0a4d01a99725ac02b",
        "d45d2f3d1d02c7163bb92ab5f276f49116a765305e516270b1fe30e33d56400e",
        "d5c59598465a8119e960a42b8f463f542ca3466b187c4d7597c853a682fd82c6",
        "dd9859616f46994d1bfe0d07e452baf51502d1c938a6bc9d6e9b3e9bcf55dd17",
        "e4919515b7fc82e8c51d1cb9dba99c100767f08f55b74aa6ab6abe9f6cc262b3",
        "e6e60d2037efe58841d698b341a609d8a738effceaadb12ac721e54f8e0bf7db",
        "eedd948601c88f2b2ca69dd51edf5b1ff4a963813a703fcd638a046148f4f6fb",
    ),
    "Zlib": (
        "0627bce7a20fbaa50330dec14fae352f824d688d48ee5d17dd7285e091f01f0c",
        "068d3cad77633b46ed4e0d287ad8c6e536ae3ed883c0edf6fb7faea9f857421f",
        "094230c3dfacf6e1ebf81963594865d20a86b788e1ce91dc4908d28522c7e8d1",
        "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
        "367e6e91e2959f49afeb2296adb5ebad77815396539e23ed3970a359cf1f61a7",
        "65e94bc66fd6a719d170c2457ffdf1ba51cb5dab6fb35a97872a0e2b661f4525",
        "8ed71078612f3d19fa64762973625f89dfef987eebc35104c897de92f3abbe6f",
        "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a",
        "c40e1a2cabaa08edfdf368c29431ae026746c884d8873ac104aac49601e4bfaa",
        "c6bf9eea7e43e5b816a3b0fa98bb0b9554e535e8d7ea285a602d2641fac07f15",
        "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145",
    ),
}
