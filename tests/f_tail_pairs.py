"""Printed F statistics with 6 numerator degrees of freedom and their p-values, to 6 decimals."""

# The pairs of a run with 13 variables, in order; 689 denominator degrees of freedom.
THIRTEEN_VARIABLES = """
1.420149 0.204151, 0.239611 0.963359, 0.578798 0.747412, 0.444134 0.849286, 0.509846 0.801134, 1.897288 0.078881
0.397386 0.880883, 0.000000 1.000000, 0.523936 0.790368, 0.000000 1.000000, 0.569213 0.755015, 0.510871 0.800354
0.518558 0.794493, 1.231143 0.288080, 2.139290 0.047105, 3.808980 0.000963, 2.450945 0.023669, 1.511844 0.171454
2.523541 0.020097, 0.000000 1.000000, 0.340036 0.915692, 0.000000 1.000000, 3.523973 0.001923, 2.443289 0.024080
0.939651 0.465739, 5.107378 0.000038, 2.541736 0.019286, 0.853085 0.529231, 0.849376 0.532041, 0.674608 0.670248
2.380733 0.027696, 0.000000 1.000000, 0.300075 0.936870, 0.000000 1.000000, 0.749936 0.609608, 0.869378 0.516964
0.810450 0.561934, 4.571430 0.000146, 3.136006 0.004861, 1.883764 0.081141, 0.873006 0.514252, 0.571946 0.752851
5.399547 0.000018, 0.000000 1.000000, 0.348311 0.910974, 0.000000 1.000000, 1.715307 0.114694, 0.882587 0.507122
2.294601 0.033531, 3.270923 0.003528, 1.207028 0.300518, 1.459944 0.189362, 0.699449 0.650159, 2.012499 0.061856
0.601851 0.728998, 0.000000 1.000000, 0.401882 0.877959, 0.000000 1.000000, 0.910559 0.486598, 0.695180 0.653608
1.490069 0.178782, 2.171429 0.043929, 7.232094 0.000000, 8.223880 0.000000, 2.121631 0.048941, 2.480224 0.022161
4.690733 0.000109, 0.000000 1.000000, 0.984653 0.434510, 0.000000 1.000000, 1.842988 0.088318, 8.727471 0.000000
0.783013 0.583391, 1.574036 0.151937, 0.998717 0.425020, 0.913704 0.484319, 0.925193 0.476042, 0.825051 0.550641
1.301963 0.253870, 0.000000 1.000000, 0.291730 0.940938, 0.000000 1.000000, 0.938918 0.466258, 0.825957 0.549943
0.775815 0.589066, 2.431059 0.024749, 1.835013 0.089788, 1.268328 0.269691, 0.233732 0.965552, 1.362771 0.227175
0.659507 0.682474, 0.000000 1.000000, 0.181283 0.981970, 0.000000 1.000000, 0.159121 0.987196, 1.373374 0.222765
0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000
0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000
1.686974 0.121434, 0.178301 0.982732, 1.467516 0.186654, 1.518653 0.169216, 1.183035 0.313298, 1.661232 0.127861
0.910330 0.486765, 1.087467 0.368246, 0.000000 1.000000, 0.000000 1.000000, 1.119466 0.349127, 1.648158 0.131241
0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000
0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000, 0.000000 1.000000
2.053282 0.056696, 3.570857 0.001717, 0.814409 0.558863, 1.163456 0.324028, 1.127274 0.344571, 0.723855 0.630494
2.157113 0.045318, 0.535658 0.781319, 0.000000 1.000000, 0.398749 0.879999, 0.000000 1.000000, 0.718885 0.634490
1.483510 0.181041, 2.138328 0.047203, 7.315661 0.000000, 8.279203 0.000000, 2.130956 0.047963, 8.689922 0.000000
2.481500 0.022097, 4.773726 0.000088, 0.000000 1.000000, 0.977090 0.439667, 0.000000 1.000000, 1.851797 0.086720
"""

# The pairs of a run with 14 variables, in order; 901 denominator degrees of freedom.
FOURTEEN_VARIABLES = """
2.226945 0.038613, 0.590259 0.738314, 1.945686 0.070881, 0.841207 0.538142, 1.481994 0.181140, 1.304594 0.252277
1.061770 0.383854, 0.634648 0.702601, 1.443514 0.194932, 0.453048 0.843054, 1.397263 0.212676, 3.626001 0.001463
2.035848 0.058495, 0.717121 0.635880, 6.019702 0.000003, 3.141731 0.004707, 2.462342 0.022839, 1.770044 0.102202
0.849692 0.531681, 4.254336 0.000310, 0.474311 0.827707, 1.986876 0.064948, 0.349357 0.910435, 1.040255 0.397516
1.555281 0.157175, 3.060118 0.005714, 1.031883 0.402919, 1.829797 0.090355, 3.150646 0.004608, 2.827325 0.009876
1.326501 0.242411, 0.691547 0.656529, 3.543237 0.001790, 0.693114 0.655262, 2.034030 0.058724, 0.335274 0.918419
0.692259 0.655954, 1.691411 0.119928, 3.057548 0.005748, 1.117035 0.350251, 1.341438 0.235866, 2.052842 0.056399
0.599910 0.730587, 2.377457 0.027643, 0.658164 0.683566, 2.112741 0.049556, 0.419352 0.866428, 0.197811 0.977438
0.572021 0.752834, 0.981681 0.436317, 0.681922 0.664320, 0.964746 0.447961, 1.532112 0.164436, 2.479834 0.021953
3.073742 0.005532, 0.505082 0.804805, 4.640577 0.000118, 1.646317 0.131292, 4.641127 0.000117, 1.910039 0.076415
1.116046 0.350834, 0.175797 0.983379, 1.398412 0.212219, 2.417744 0.025254, 0.490950 0.815417, 2.885599 0.008619
3.705906 0.001204, 3.704018 0.001209, 5.155270 0.000032, 2.795794 0.010629, 1.400308 0.211468, 2.420955 0.025072
0.597865 0.732226, 0.894998 0.497808, 1.186412 0.311136, 1.116454 0.350594, 1.833360 0.089690, 5.194262 0.000029
0.110375 0.995246, 1.075277 0.375443, 1.551741 0.158266, 2.688607 0.013624, 1.361105 0.227470, 0.395492 0.882177
0.509261 0.801639, 0.094877 0.996874, 0.548625 0.771270, 0.079957 0.998066, 6.776292 0.000000, 0.984466 0.434420
2.754009 0.011712, 1.195936 0.306033, 0.332357 0.920033, 1.882150 0.081019, 0.410375 0.872436, 0.641679 0.696914
0.899320 0.494635, 0.421496 0.864979, 1.048906 0.391984, 0.491573 0.814952, 3.566155 0.001693, 0.357521 0.905662
0.302898 0.935521, 0.428166 0.860435, 1.170357 0.319884, 0.349767 0.910197, 1.309991 0.249817, 1.109443 0.354740
0.730321 0.625262, 1.216758 0.295098, 1.414373 0.205960, 0.533561 0.782999, 1.020829 0.410126, 13.594616 0.000000
1.153316 0.329369, 1.139275 0.337340, 1.066086 0.381152, 0.458973 0.838821, 2.240515 0.037476, 6.592658 0.000001
4.401929 0.000214, 2.066149 0.054806, 4.252062 0.000312, 4.098161 0.000457, 4.623442 0.000123, 0.943310 0.462964
0.584275 0.743091, 2.549273 0.018751, 3.421811 0.002403, 4.233851 0.000326, 1.848918 0.086837, 1.150622 0.330888
0.577708 0.748319, 0.813189 0.559714, 1.515551 0.169802, 1.302602 0.253190, 1.368531 0.224364, 0.824510 0.550955
18.548594 0.000000, 0.660519 0.681658, 1.261477 0.272635, 1.119330 0.348903, 0.862779 0.521786, 0.059480 0.999166
1.021267 0.409839, 1.179266 0.315007, 2.283144 0.034106, 1.055723 0.387661, 0.615711 0.717885, 4.437969 0.000196
0.351151 0.909395, 0.113568 0.994858, 0.251059 0.958932, 0.044310 0.999643, 1.005658 0.420154, 2.374871 0.027804
1.560955 0.155440, 1.926523 0.073808, 1.760247 0.104274, 2.263959 0.035585, 0.984714 0.434251, 1.723199 0.112454
1.658926 0.128022, 1.439747 0.196329, 0.302423 0.935758, 2.372750 0.027936, 0.282855 0.945176, 1.149245 0.331666
2.194767 0.041440, 0.713559 0.638750, 1.616342 0.139366, 3.261141 0.003538, 0.907731 0.488491, 0.799197 0.570614
2.184898 0.042346, 0.652858 0.687864, 3.067414 0.005616, 0.714924 0.637650, 1.243800 0.281349, 0.579079 0.747229
1.101137 0.359697, 0.724761 0.629731
"""


def pairs(text: str) -> list[tuple[float, float]]:
    return [tuple(map(float, pair.split())) for line in text.strip().splitlines() for pair in line.split(", ")]
