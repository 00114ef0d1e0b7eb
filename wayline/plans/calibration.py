"""The calibration that the queries use for all cameras: four image points, their places on a 900 x 600 floorplan, and the plane that they fix."""

SOURCE = [[100, 250], [1000, 250], [1200, 480], [0, 480]]
TARGET = [[50, 50], [850, 50], [850, 550], [50, 550]]
#: As geometry.fit_homography solves it; written down, because the last digit of a solution depends on the machine, and whole places at their edge on it.
H = [1.393939393939394, 0.7196969696969698, -240.90909090909093, 0.0, 4.659090909090909, -1086.3636363636365, 9.186815169423519e-20, 0.0022727272727272726, 1.0]
#: Frame size of the queries on boxes.
WIDTH, HEIGHT = 1280, 720
